"""Causal graphs: a store of definitions, identification, grading of covariates, d-separation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from pyspark.errors import AnalysisException

from ..errors import CausalError

#: The mark of a proposal that nobody has reviewed.
UNREVIEWED = "do_discover: unreviewed"
_TOKEN = re.compile(r'\s+|//[^\n]*|#[^\n]*|/\*.*?\*/|"((?:[^"\\]|\\.)*)"|(->|--|<-)|([\w.:]+)|([{}\[\];=,])|(.)', re.S)


@dataclass
class Dag:
    nodes: list[str] = field(default_factory=list)
    edges: list[tuple[int, int]] = field(default_factory=list)
    latent: set[int] = field(default_factory=set)

    def index(self, name: str) -> int:
        for i, n in enumerate(self.nodes):
            if n.lower() == name.lower():
                return i
        raise CausalError(f'unknown node "{name}"; the graph has {", ".join(self.nodes)}')

    def add(self, name: str) -> int:
        for i, n in enumerate(self.nodes):
            if n.lower() == name.lower():
                return i
        self.nodes.append(name)
        return len(self.nodes) - 1

    def parents(self, i: int) -> set[int]:
        return {a for a, b in self.edges if b == i}

    def children(self, i: int) -> set[int]:
        return {b for a, b in self.edges if a == i}

    def _closure(self, start, step) -> set[int]:
        found, todo = set(), list(start)
        while todo:
            for j in step(todo.pop()):
                if j not in found:
                    found.add(j)
                    todo.append(j)
        return found

    def descendants(self, *start: int) -> set[int]:
        return self._closure(start, self.children)

    def ancestors(self, *start: int) -> set[int]:
        return self._closure(start, self.parents)

    def without(self, keep) -> Dag:
        return Dag(self.nodes, [e for e in self.edges if keep(e)], self.latent)

    def separated(self, x: int, y: int, given) -> bool:
        """d-separation: no path in the moral graph of the ancestors avoids the given nodes."""
        given = set(given)
        if x in given or y in given:
            return True
        if x == y:
            return False
        inside = {x, y} | given | self.ancestors(x, y, *given)
        near: dict[int, set[int]] = {i: set() for i in inside}
        for i in inside:
            up = self.parents(i) & inside
            for p in up:
                near[p].add(i)
                near[i].add(p)
                near[p] |= up - {p}
        return y not in self._closure([x], lambda i: near[i] - given)


def parse(text: str) -> Dag:
    """A graph in the DOT language: chains of ``->``, quoted names, comments, ``[latent]`` or ``[unobserved]``."""
    dag, at, tokens = Dag(), 0, []
    for m in _TOKEN.finditer(text):
        if m[5]:
            raise CausalError(f'unexpected "{m[5]}" in the graph')
        if m[1] is not None:
            tokens.append(("name", re.sub(r"\\(.)", r"\1", m[1])))
        elif m[2]:
            tokens.append(("edge", m[2]))
        elif m[3]:
            tokens.append(("name", m[3]))
        elif m[4]:
            tokens.append((m[4], m[4]))
    names = [v.lower() for k, v in tokens if k == "name"]
    while at < len(tokens) and tokens[at][0] == "name" and names and tokens[at][1].lower() in ("strict", "digraph", "graph", "dag"):
        at += 1
    if at < len(tokens) and at + 1 < len(tokens) and tokens[at][0] == "name" and tokens[at + 1][0] == "{":
        at += 1
    last: int | None = None
    pending: list[int] = []
    arrow: str | None = None
    while at < len(tokens):
        kind, value = tokens[at]
        at += 1
        if kind in "{};,":
            last, arrow, pending = None, None, []
        elif kind == "edge":
            if last is None:
                raise CausalError("an edge without a node before it")
            arrow = value
        elif kind == "[":
            inside = []
            while at < len(tokens) and tokens[at][0] != "]":
                inside.append(tokens[at])
                at += 1
            at += 1
            words = [v.lower() for k, v in inside if k == "name"]
            # latent, or latent=true; observed=true marks nothing.
            for i, w in enumerate(words):
                if w in ("latent", "unobserved") and words[i + 1 : i + 2] != ["false"]:
                    dag.latent |= set(pending[-1:])
        elif kind == "name":
            if arrow is None and last is None and at < len(tokens) and tokens[at][0] == "=":
                at += 2
                continue
            if arrow is None and last is None and value.lower() in ("node", "edge", "graph") and at < len(tokens) and tokens[at][0] == "[":
                while at < len(tokens) and tokens[at][0] != "]":
                    at += 1
                at += 1
                continue
            i = dag.add(value)
            if arrow == "--":
                raise CausalError(f'"{dag.nodes[last]} -- {value}" has no direction: decide which of the two causes the other')
            if arrow is not None:
                edge = (last, i) if arrow == "->" else (i, last)
                if edge not in dag.edges:
                    dag.edges.append(edge)
            elif last is not None:
                pending = []
            last, arrow = i, None
            pending.append(i)
    if not dag.nodes:
        raise CausalError("the graph is empty")
    free = [i for i in range(len(dag.nodes)) if not dag.parents(i)]
    left = {i: len(dag.parents(i)) for i in range(len(dag.nodes))}
    seen = 0
    while free:
        i = free.pop()
        seen += 1
        for j in dag.children(i):
            left[j] -= 1
            if left[j] == 0:
                free.append(j)
    if seen < len(dag.nodes):
        raise CausalError("the graph has a cycle")
    return dag


_STORE = "causalith_graphs"


def _place(engine) -> str:
    return f"{engine.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{_STORE}"


def _stored(engine) -> dict[str, str]:
    """Definitions by name, from a table in the warehouse, which is small by its nature and outlives the session."""
    try:
        return {r["name"]: r["definition"] for r in engine.spark.read.schema("name string, definition string").parquet(_place(engine)).collect()}
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}


def _store(engine, graphs: dict[str, str]) -> None:
    engine.table(sorted(graphs.items()), "name string, definition string").coalesce(1).write.mode("overwrite").parquet(_place(engine))


def lookup(engine, name: str) -> Dag:
    text = _stored(engine).get(str(name).lower())
    if text is None:
        raise CausalError(f'no graph "{name}"; create it with do_graph_create')
    return parse(text)


def do_graph_create(engine, name: str, dot: str):
    """Store a graph under a name, in place of an older one."""
    if UNREVIEWED in dot:
        raise CausalError("this is a proposal that was not reviewed: check its edges and take out the comment that says so")
    dag = parse(dot)
    _store(engine, _stored(engine) | {name.lower(): dot})
    return engine.table([(name, len(dag.nodes), len(dag.edges), len(dag.latent))], "name string, n_nodes long, n_edges long, n_latent long")


def do_graph_drop(engine, name: str):
    graphs = _stored(engine)
    found = graphs.pop(name.lower(), None) is not None
    if found:
        _store(engine, graphs)
    return engine.table([(name, found)], "name string, dropped boolean")


def do_graphs(engine):
    rows = []
    for name, text in sorted(_stored(engine).items()):
        try:
            dag = parse(text)
        except CausalError:
            continue
        rows.append((name, len(dag.nodes), len(dag.edges), dag.nodes))
    return engine.table(rows, "name string, n_nodes long, n_edges long, nodes array<string>")


def backdoor(dag: Dag, t: int, y: int) -> tuple[bool, list[int], str]:
    """Whether observed non-descendants block the back doors, a set that does, and why not."""
    cut = dag.without(lambda e: e[0] != t)
    below = dag.descendants(t)
    candidates = [i for i in range(len(dag.nodes)) if i in dag.ancestors(t, y) and i not in below and i not in dag.latent and i not in (t, y)]
    if not cut.separated(t, y, candidates):
        both = dag.ancestors(t) & dag.ancestors(y)
        latent = [i for i in range(len(dag.nodes)) if i in both and i in dag.latent]
        return False, [], f'"{dag.nodes[latent[0]]}" is a common cause that is not observed' if latent else "no observed set blocks every back door"
    chosen = list(candidates)
    for i in candidates:
        rest = [j for j in chosen if j != i]
        if cut.separated(t, y, rest):
            chosen = rest
    return True, chosen, "adjust for these" if chosen else "nothing to adjust for"


def frontdoor(dag: Dag, t: int, y: int) -> int | None:
    for m in range(len(dag.nodes)):
        if m in (t, y) or m in dag.latent or m not in dag.descendants(t) or m not in dag.ancestors(y):
            continue
        if y in dag.without(lambda e, m=m: m not in e).descendants(t):
            continue
        if not dag.without(lambda e: e[0] != t).separated(t, m, []):
            continue
        if dag.without(lambda e, m=m: e[0] != m).separated(m, y, [t]):
            return m
    return None


def instrument(dag: Dag, t: int, y: int) -> int | None:
    cut = dag.without(lambda e: e[0] != t)
    for z in range(len(dag.nodes)):
        if z in (t, y) or z in dag.latent or z in dag.descendants(t) or z not in dag.ancestors(t):
            continue
        if cut.separated(z, y, []):
            return z
    return None


def do_identify(engine, graph: str, treatment: str, outcome: str):
    """Whether the back-door, front-door and instrument strategies identify the effect, and by what."""
    dag = lookup(engine, graph)
    t, y = dag.index(treatment), dag.index(outcome)
    ok, chosen, note = backdoor(dag, t, y)
    m, z = frontdoor(dag, t, y), instrument(dag, t, y)
    name = dag.nodes
    rows = [
        ("backdoor", ok, [name[i] for i in chosen], note),
        ("frontdoor", m is not None, [name[m]] if m is not None else [], f'through "{name[m]}"' if m is not None else "no observed mediator carries the whole effect"),
        ("iv", z is not None, [name[z]] if z is not None else [], f'"{name[z]}" is an instrument' if z is not None else "no observed instrument"),
    ]
    return engine.table(rows, "strategy string, identifiable boolean, adjustment_set array<string>, note string")


def role(dag: Dag, t: int, y: int, name: str) -> tuple[str, str, str]:
    """A covariate's role, what to do with it, and why."""
    try:
        c = dag.index(name)
    except CausalError:
        return "unknown", "CHECK", "the graph does not have it"
    below = dag.descendants(t)
    if c == t:
        return "treatment", "DROP", "it is the treatment"
    if c == y:
        return "outcome", "DROP", "it is the outcome"
    if c in dag.latent:
        return "latent", "DROP", "it is not observed"
    if c in dag.descendants(y):
        return "outcome descendant", "DROP", "it follows from the outcome"
    if c in below:
        if y in dag.descendants(c):
            return "mediator", "DROP", "the effect passes through it"
        return "post-treatment", "DROP", "it follows from the treatment"
    to_t, cut = t in dag.descendants(c), dag.without(lambda e: e[0] != t)
    to_y = y in cut.descendants(c)
    if to_t and to_y:
        return "confounder", "keep", "it causes both"
    if to_t:
        if cut.separated(c, y, []):
            return "instrument", "DROP", "it acts on the outcome through the treatment alone"
        return "confounder", "keep", "it lies on a back door"
    if to_y:
        return "precision variable", "keep", "it explains the outcome"
    if cut.separated(t, y, []) and not cut.separated(t, y, [c]):
        return "collider", "DROP", "adjusting for it opens a path"
    return "unrelated", "optional", "it causes neither"


def do_validate(engine, graph: str, treatment: str, outcome: str, covariates: list):
    """The role of each covariate in a graph, and what to do with it."""
    dag = lookup(engine, graph)
    t, y = dag.index(treatment), dag.index(outcome)
    return engine.table([(c, *role(dag, t, y, c)) for c in covariates], "covariate string, role string, verdict string, reason string")


def dseparated(engine, graph, x, y, given=None):
    """Whether x and y are d-separated given a set; null if any argument is null."""
    if graph is None or x is None or y is None or (given is not None and None in given):
        return None
    dag = lookup(engine, graph)
    return dag.separated(dag.index(x), dag.index(y), [dag.index(z) for z in given or []])


def register_dseparated(engine) -> None:
    """Make ``do_dseparated(graph, x, y[, given])`` a function of SQL, over the graphs stored now."""
    graphs = _stored(engine)

    @F.udf("boolean")
    def function(graph, x, y, given=None):
        if graph is None or x is None or y is None:
            return None
        dag = parse(graphs[graph.lower()])
        return dag.separated(dag.index(x), dag.index(y), [dag.index(z) for z in given or []])

    engine.spark.udf.register("do_dseparated", function)
