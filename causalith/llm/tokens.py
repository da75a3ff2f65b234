"""Token ids of whole texts by a tokenizer file, computed once per distinct word."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged


class WordTokenizer:
    """Encodes texts with a tokenizer whose pre-tokenizer drops white space, so a text's ids are those of its words.

    Trailing punctuation is split off a word where the pre-tokenizer splits there anyway, and ASCII letters are lowered
    where the normalizer lowers them, so that more words are equal. ``keep`` words stay known between calls: the bound
    of this cache's memory; words beyond it are encoded again when they return.
    """

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.place: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each word's ids in one array of ids."""
        found = np.fromiter(map(self.place.get, words, [-1] * len(words)), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        fresh = [words[i] for i in new.tolist()]
        got = [x.ids for x in self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)] if fresh else []
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((y for x in got for y in x), np.uint32, int(lengths.sum()))
        known = len(self.starts) - 1
        starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        found[new] = known + np.arange(len(new))
        flat = np.concatenate([self.flat, flat])
        room = max(0, self.keep - known)
        if room and len(fresh):
            self.place.update(zip(fresh[:room], range(known, known + room), strict=False))
            self.starts = starts[: known + min(room, len(fresh)) + 1].copy()
            self.flat = flat[: self.starts[-1]].copy()
        return starts[found], starts[found + 1] - starts[found], flat

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the texts' offsets in them; null counts as empty."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        flat = words.flatten()
        word_doc = np.diff(np.asarray(words.offsets))
        coded = flat.dictionary_encode()
        index, distinct = np.asarray(coded.indices), coded.dictionary
        # Contractions and special tokens hold an apostrophe or "<|"; those words stay as they are.
        parts = pc.extract_regex(distinct, r"^(?P<a>[^'<]*[\pL\pN])(?P<b>[.,!?;:%#&$*]+)$")
        split = np.asarray(parts.is_valid())
        # In RE2 a letter or digit before the run ends the word's last pre-token, and the run is one pre-token.
        head = pc.if_else(parts.is_valid(), pc.struct_field(parts, "a"), distinct)
        tail = pc.if_else(parts.is_valid(), pc.struct_field(parts, "b"), pa.scalar("", pa.large_string()))
        special = np.asarray(pc.match_substring(head, "<"))
        head = pc.if_else(pa.array(special), head, pc.ascii_lower(head))
        both = pa.concat_arrays([head, tail.filter(pa.array(split))]).dictionary_encode()
        s, n, ids = self._words(both.dictionary.to_pylist())
        code = np.asarray(both.indices)
        k = len(distinct)
        head_code, tail_code = code[:k], np.full(k, -1, np.int64)
        tail_code[split] = code[k:]
        # Each word gives one or two runs of ids.
        runs = np.stack([head_code, tail_code], 1)[index].ravel()
        doc = np.repeat(np.repeat(np.arange(len(texts)), word_doc), 2)
        used = runs >= 0
        runs, doc = runs[used], doc[used]
        lengths = n[runs]
        out = ids[ragged(s[runs], lengths)]
        per_doc = np.bincount(doc, lengths, len(texts)).astype(np.int64)
        if end_id is None:
            return out, np.concatenate([[0], np.cumsum(per_doc)])
        offsets = np.concatenate([[0], np.cumsum(per_doc + 1)])
        whole = np.full(offsets[-1], end_id, np.uint32)
        inner = np.ones(len(whole), bool)
        inner[offsets[1:] - 1] = False
        whole[inner] = out
        return whole, offsets


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
