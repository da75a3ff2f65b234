"""The catalogue of foundation models, devices, and fetching of model files.

Weights are not part of this library and nothing here uses a network: models are listed, their files can be copied from a
folder and verified, and an estimate by a model whose files are absent is refused.
"""

from __future__ import annotations

import hashlib
import os
import shutil

from ..errors import CausalError

#: Name, licence, commercial use, attribution, most covariates, context sizes.
CATALOGUE = [("causalpfn", "MIT", True, False, 100, [128, 512, 1024, 2048]), ("do_pfn", "research only", False, True, 40, [128, 512, 1024, 2048])]
_FILES = ("encoder.onnx", "decoder.onnx")


def _folder(engine, name: str) -> str:
    base = engine.config.model_dir or os.path.join(os.path.expanduser("~"), ".cache", "causalith")
    return os.path.join(base, name)


def refuse(name: str) -> None:
    known = [m[0] for m in CATALOGUE]
    if name not in known:
        raise CausalError(f'unknown model "{name}"; use one of {", ".join(known)}')
    raise CausalError(f'the files of the model "{name}" are not available; see do_list_models and do_download')


def do_list_models(engine):
    rows = []
    for name, licence, commercial, attribution, covariates, ladder in CATALOGUE:
        have = all(os.path.exists(os.path.join(_folder(engine, name), f)) for f in _FILES)
        rows.append((name, "model_dir", licence, commercial, attribution, covariates, ladder, have, "ready" if have else f"no files in {_folder(engine, name)}"))
    return engine.table(rows, "model string, setting string, license string, commercial boolean, attribution_required boolean, max_covariates long, context_ladder array<long>, available boolean, detail string")


def do_models(engine):
    return do_list_models(engine)


def do_devices(engine):
    rows = [("cpu", True, "always there"), *((d, False, "not supported by this library") for d in ("cuda", "rocm", "mlx"))]
    return engine.table(rows, "device string, available boolean, detail string")


def _digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def do_download(engine, model: str, source: str | None = None, overwrite: bool = False, verify: bool | None = None, pins: dict | None = None):
    """Copy a model's files from a folder; a file that is there stays unless ``overwrite``. ``pins``: expected SHA-256 by file."""
    if model not in [m[0] for m in CATALOGUE]:
        raise CausalError(f'unknown model "{model}"')
    if source is None or "://" in str(source):
        raise CausalError("a source folder is required: nothing is fetched from a network")
    verify = source is None if verify is None else verify
    folder, rows = _folder(engine, model), []
    os.makedirs(folder, exist_ok=True)
    for name in _FILES:
        to, origin = os.path.join(folder, name), os.path.join(source, name)
        if os.path.exists(to) and not overwrite:
            rows.append((model, name, os.path.getsize(to), _digest(to), "kept", source))
            continue
        if not os.path.exists(origin):
            raise CausalError(f"{origin} does not exist")
        shutil.copyfile(origin, to + ".part")
        digest = _digest(to + ".part")
        if verify and (pins or {}).get(name) not in (None, digest):
            os.remove(to + ".part")
            raise CausalError(f"{name} has the SHA-256 {digest}, not the expected one")
        os.replace(to + ".part", to)
        rows.append((model, name, os.path.getsize(to), digest, "copied", source))
    return engine.table(rows, "model string, file string, bytes long, sha256 string, status string, source string")
