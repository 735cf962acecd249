"""Character lattices of surfaces under the rules, and dynamic programs over them.

An edge is (start, end, text, rule_id): a letter that stands for itself, or a rule's
written form that stands for left#right.  Edges are sorted by (start, end, identity
first, order), which decides ties.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.operators.rules import surface_matches
from lexispan.session import dealt, spread

NEVER = -math.inf


class Edge(NamedTuple):
    start: int
    end: int
    text: str
    rule_id: str | None


def log_add(values: list[float]) -> float:
    """ln of the summed exponentials."""
    top = max(values, default=NEVER)
    return NEVER if top == NEVER else top + math.log(sum(math.exp(v - top) for v in values))


def edge_rows(surfaces: DataFrame, rules: DataFrame, *, key: str = "surface_text") -> DataFrame:
    """Lattice edges as rows: (key, start, end, text, rule_id, ord)."""
    own = surfaces.select(key, F.posexplode(F.filter(F.split(key, ""), lambda c: c != "")).alias("start", "text"))
    identity = own.select(key, "start", (F.col("start") + 1).alias("end"), "text", F.lit(None).cast("string").alias("rule_id"), F.lit(-1).alias("ord"))
    ruled = surface_matches(surfaces, rules, key=key).select(key, "start", "end", F.concat("left", F.lit("#"), "right").alias("text"), "rule_id", "ord")
    return identity.unionByName(ruled)


def lattices(surfaces: DataFrame, rules: DataFrame, *, key: str = "surface_text") -> DataFrame:
    """(key, edges): one sorted array of edges for each surface; its size is bounded by the surface's length times the rules."""
    edges = edge_rows(surfaces, rules, key=key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "ord", "text", "rule_id"))).alias("edges"))
    return surfaces.select(key).distinct().join(edges, key, "left")


class Lattice:
    """The edges of one surface, by their start."""

    def __init__(self, size: int, edges: list[Edge]) -> None:
        self.size, self.edges = size, edges
        self.out: dict[int, list[int]] = defaultdict(list)
        for k, e in enumerate(edges):
            self.out[e.start].append(k)

    def paths(self) -> int:
        """How many ways lead through."""
        ways = [1] + [0] * self.size
        for at in range(self.size):
            for k in self.out[at]:
                ways[self.edges[k].end] += ways[at]
        return ways[-1]

    def forward(self, score: Callable[[Edge], float]) -> list[float]:
        """Log score of all ways to each place; the last one is the log partition."""
        into: list[list[float]] = [[] for _ in range(self.size + 1)]
        into[0].append(0.0)
        out = []
        for at in range(self.size + 1):
            value = log_add(into[at])
            out.append(value)
            for k in self.out[at] if value > NEVER else ():
                into[self.edges[k].end].append(value + score(self.edges[k]))
        return out

    def best(self, score: Callable[[Edge], float]) -> tuple[float, list[Edge]]:
        """The best way; of equal ones the first in edge order."""
        value, back = [0.0] + [NEVER] * self.size, [None] * (self.size + 1)
        for at in range(self.size):
            if value[at] > NEVER:
                for k in self.out[at]:
                    e = self.edges[k]
                    if value[at] + score(e) > value[e.end]:
                        value[e.end], back[e.end] = value[at] + score(e), k
        way, at = [], self.size
        while at and back[at] is not None:
            way.append(self.edges[back[at]])
            at = way[-1].start
        return value[-1], way[::-1]

    def all_paths(self, limit: int) -> Iterator[list[Edge]]:
        """Up to `limit` ways, for tests."""
        stack: list[tuple[int, list[Edge]]] = [(0, [])]
        while stack and limit:
            at, way = stack.pop()
            if at == self.size:
                limit -= 1
                yield way
                continue
            stack += [(self.edges[k].end, [*way, self.edges[k]]) for k in reversed(self.out[at])]


class NGrams:
    """Smoothed n-gram probabilities from counts {(context, symbol): n}; a context is a string of order - 1 symbols."""

    BOS, EOS, UNK = "\x02", "\x03", "\x00"

    def __init__(self, order: int, alpha: float, counts: dict[tuple[str, str], float], alphabet: set[str]) -> None:
        self.order, self.alpha, self.counts = order, alpha, counts
        self.alphabet = alphabet | {self.EOS, self.UNK}
        self.totals: dict[str, float] = defaultdict(float)
        for (context, _), n in counts.items():
            self.totals[context] += n

    def known(self, symbol: str) -> str:
        return symbol if symbol in self.alphabet else self.UNK

    def step(self, context: str, symbol: str) -> str:
        return (context + symbol)[-(self.order - 1) :] if self.order > 1 else ""

    def log_prob(self, symbol: str, context: str) -> float:
        s = self.known(symbol)
        return math.log((self.counts.get((context, s), 0.0) + self.alpha) / (self.totals.get(context, 0.0) + self.alpha * len(self.alphabet)))

    def read(self, text: str, context: str) -> tuple[float, str, list[tuple[str, str]]]:
        """Score of a text after a context, the context after it, and the transitions made."""
        score, made = 0.0, []
        for c in text:
            s = self.known(c)
            score += self.log_prob(s, context)
            made.append((context, s))
            context = self.step(context, s)
        return score, context, made

    @property
    def begin(self) -> str:
        return self.BOS * (self.order - 1)


class NGramLattice:
    """The product of a lattice with n-gram contexts: states are (place, context)."""

    def __init__(self, lattice: Lattice, model: NGrams, *, end: bool = True) -> None:
        self.lattice, self.model = lattice, model
        into: list[dict[str, list[float]]] = [defaultdict(list) for _ in range(lattice.size + 1)]
        into[0][model.begin].append(0.0)
        self.alpha: list[dict[str, float]] = []
        self.arcs: list[tuple[int, str, int, str, int, float, list[tuple[str, str]]]] = []
        for at in range(lattice.size + 1):
            here = {c: log_add(v) for c, v in into[at].items()}
            self.alpha.append(here)
            for context, value in here.items():
                for k in lattice.out[at]:
                    e = lattice.edges[k]
                    score, after, made = model.read(e.text, context)
                    into[e.end][after].append(value + score)
                    self.arcs.append((at, context, e.end, after, k, score, made))
        self.final = {c: model.log_prob(model.EOS, c) if end else 0.0 for c in self.alpha[-1]}
        self.log_z = log_add([v + self.final[c] for c, v in self.alpha[-1].items()])
        self.end = end

    def best(self) -> tuple[float, list[Edge]]:
        value: dict[tuple[int, str], float] = {(0, self.model.begin): 0.0}
        back: dict[tuple[int, str], tuple[tuple[int, str], int]] = {}
        for at, context, to, after, k, score, _ in self.arcs:
            v = value[at, context] + score
            if v > value.get((to, after), NEVER):
                value[to, after], back[to, after] = v, ((at, context), k)
        last = max(((value[self.lattice.size, c] + f, c) for c, f in self.final.items()), key=lambda x: x[0])
        way, state = [], (self.lattice.size, last[1])
        while state in back:
            state, k = back[state]
            way.append(self.lattice.edges[k])
        return last[0], way[::-1]

    def posteriors(self) -> tuple[list[float], dict[tuple[str, str], float]]:
        """Probability of each edge, and the expected count of each transition, the end mark's included."""
        out: dict[tuple[int, str], list[float]] = defaultdict(list)
        for c, f in self.final.items():
            out[self.lattice.size, c].append(f)
        beta: dict[tuple[int, str], float] = {}
        by_state = defaultdict(list)
        for arc in self.arcs:
            by_state[arc[0], arc[1]].append(arc)
        for at in range(self.lattice.size, -1, -1):
            for context in self.alpha[at]:
                for _, _, to, after, _, score, _ in by_state[at, context]:
                    out[at, context].append(score + beta[to, after])
                beta[at, context] = log_add(out[at, context])
        edges, counts = [0.0] * len(self.lattice.edges), defaultdict(float)
        for at, context, to, after, k, score, made in self.arcs:
            p = math.exp(self.alpha[at][context] + score + beta[to, after] - self.log_z)
            edges[k] += p
            for move in made:
                counts[move] += p
        if self.end:
            for c, f in self.final.items():
                counts[c, self.model.EOS] += math.exp(self.alpha[-1][c] + f - self.log_z)
        return edges, counts


def kind_bias(identity: float, ruled: float) -> Callable[[Edge], float]:
    """A scorer that prefers letters or rules."""
    return lambda e: identity if e.rule_id is None else ruled


def _lattice_of(surface: str, edges: list[dict] | None) -> Lattice:
    return Lattice(len(surface), [Edge(e["start"], e["end"], e["text"], e["rule_id"]) for e in edges or []])


def lattice_summary(frame: DataFrame, *, key: str = "surface_text", identity: float = 0.0, ruled: float = 0.0) -> DataFrame:
    """(key, paths, log_partition, best_score, best_text) of each lattice under a scorer by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = kind_bias(identity, ruled)
        for batch in batches:
            rows = []
            for surface, edges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lattice = _lattice_of(surface, edges)
                value, way = lattice.best(score)
                rows.append((surface, float(lattice.paths()), lattice.forward(score)[-1], value, "".join(e.text for e in way)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)] if rows else [], names=[key, "paths", "log_partition", "best_score", "best_text"])

    return dealt(frame.select(key, "edges"), key).mapInArrow(run, f"{key} string, paths double, log_partition double, best_score double, best_text string")


def ngram_expectations(frame: DataFrame, model: NGrams, *, key: str = "surface_text") -> DataFrame:
    """(kind, a, b, mass): expected transitions ('ngram', context, symbol), rule posteriors ('rule', rule_id, null), log partitions ('log_z', surface, null)."""
    shared = frame.sparkSession.sparkContext.broadcast(model)  # bounded by alphabet ** order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str, str | None], float] = defaultdict(float)
            for surface, edges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                product = NGramLattice(_lattice_of(surface, edges), shared.value)
                mass, counts = product.posteriors()
                for (context, symbol), n in counts.items():
                    sums["ngram", context, symbol] += n
                for e, p in zip(product.lattice.edges, mass, strict=True):
                    if e.rule_id is not None:
                        sums["rule", e.rule_id, None] += p
                sums["log_z", surface, None] += product.log_z
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in keys], type=pa.string()) for i in range(3)] + [pa.array([sums[k] for k in keys], type=pa.float64())], names=["kind", "a", "b", "mass"]
            )

    return spread(frame.select(key, "edges")).mapInArrow(run, "kind string, a string, b string, mass double").groupBy("kind", "a", "b").agg(F.sum("mass").alias("mass"))


def surface_model(surfaces: list[str], alphabet: set[str], *, order: int, alpha: float) -> NGrams:
    """Counts of the surfaces as they are written; `alphabet` adds what only rules can emit."""
    counts: dict[tuple[str, str], float] = defaultdict(float)
    model = NGrams(order, alpha, {}, alphabet | {c for s in surfaces for c in s})
    for s in surfaces:
        _, context, made = model.read(s, model.begin)
        for move in [*made, (context, model.EOS)]:
            counts[move] += 1.0
    return NGrams(order, alpha, dict(counts), model.alphabet)


def train_ngrams(frame: DataFrame, model: NGrams, passes: int) -> tuple[NGrams, list[float]]:
    """Expectation-maximisation: expected transitions replace the counts; alphabet and alpha stay.  Returns the model and the log partition before each pass."""
    history = []
    for _ in range(passes):
        rows = ngram_expectations(frame, model).where("kind <> 'rule'")
        context = F.when(F.col("kind") == "ngram", F.col("a"))  # log partitions of all surfaces become one row
        table = rows.groupBy("kind", context.alias("a"), "b").agg(F.sum("mass").alias("m")).toArrow().to_pylist()
        history.append(sum(r["m"] for r in table if r["kind"] == "log_z"))
        model = NGrams(model.order, model.alpha, {(r["a"], r["b"]): r["m"] for r in table if r["kind"] == "ngram" and r["m"] > 0}, model.alphabet)
    return model, history
