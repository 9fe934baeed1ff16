"""Personal data by candidate generators and gradient-boosted trees, all as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semtab.llm.common import whole_text
from semtab.llm.rules import let
from semtab.runtime import col, require_columns, stage

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the base kinds. Possessive repeats and looks behind change no match; they keep long runs linear
# and off the stack of the regex engine.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators beside the base: forms that a rule can't tell by itself.
WIDER = {
    "email": rf"[A-Za-z0-9][{_LOCAL}]{{0,63}} ?(?:\[at\]|\(at\)|\{{at\}}) ?[A-Za-z0-9-]{{1,63}}(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{{1,63}}){{1,4}}",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{4}(?![0-9])",
}
#: Words before a span that speak for its kind.
HINTS = r"(?i)(e-?mail|mail|contact|kontakt|call|tel|phone|fon|mobil|cell|card|karte|carte|tarjeta|visa|ip|host|server)[^\r\n]{0,12}$"

_SPANS = "array<struct<start:int,end:int,found:string,before:string,behind:string>>"
_POWERS = [1 << k for k in range(30)]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join`` makes of each value and all before it: every round reaches twice as far back, n log n in all.

    ``join`` gets a value and an earlier one, which is missing at the begin of the array.
    """
    steps = F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p < F.size(values))
    return F.aggregate(steps, values, lambda acc, by: F.transform(acc, lambda x, i: join(x, F.get(acc, i - by))))


def below(ascending: Column, x: Column) -> Column:
    """How many numbers of a sorted array are less than ``x``, by halving."""
    powers = F.array(*[F.lit(p) for p in reversed(_POWERS)])
    return F.aggregate(F.filter(powers, lambda p: p <= F.size(ascending)), F.lit(0), lambda at, p: F.when(F.get(ascending, at + p - 1) < x, at + p).otherwise(at))


def occurrences(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places and neighbours; the pieces between matches give both.

    ``before`` holds up to 24 characters of the piece before and the match before that, ``behind`` the next one. No text is
    read from its begin again for a match.
    """

    def place(x: Column) -> Column:
        sizes = F.transform(x["found"], lambda found, i: F.length(F.get(x["between"], i)) + F.length(found))
        ends = running(sizes, lambda size, earlier: size + F.coalesce(earlier, F.lit(0)))
        return let(F.struct(x["found"].alias("found"), x["between"].alias("between"), ends.alias("ends")), described)

    def described(x: Column) -> Column:
        def one(found: Column, i: Column) -> Column:
            before = F.right(F.concat(F.coalesce(F.get(x["found"], i - 1), F.lit("")), F.get(x["between"], i)), F.lit(24))
            behind = F.left(F.concat(F.left(F.get(x["between"], i + 1), F.lit(1)), F.left(F.coalesce(F.get(x["found"], i + 1), F.lit("")), F.lit(1))), F.lit(1))
            to = F.get(x["ends"], i)
            return F.struct((to - F.length(found)).alias("start"), to.alias("end"), found.alias("found"), before.alias("before"), behind.alias("behind"))

        return F.transform(x["found"], one)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.when(text.rlike(pattern), let(both, place)).otherwise(F.array().cast(_SPANS))


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(turned, i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def is_valid(kind: str, found: Column) -> Column:
    """What a match of a base pattern must still fulfil."""
    n = F.length(digits_of(found))
    if kind == "ip":
        return F.forall(F.split(found, r"\.", -1), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int") <= 255, F.lit(True)))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), passes_luhn(digits_of(found))).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _char_class(c: Column) -> Column:
    return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike("^[0-9]"), 3).when(c.rlike(r"^\p{L}"), 2).otherwise(1)


def _features(generator: int, span: Column) -> dict[str, Column]:
    found, before = span["found"], span["before"]
    digits = digits_of(found)
    return {
        "generator": F.lit(generator),
        "digits": F.least(F.length(digits), F.lit(24)),
        "size": F.least(F.length(found), F.lit(40)),
        "separators": F.least(F.length(F.regexp_replace(found, "[A-Za-z0-9]", "")), F.lit(8)),
        "opens": F.when(found.startswith("+"), 2).when(found.startswith("("), 1).otherwise(0),
        "first": F.coalesce(F.substr(digits, F.lit(1), F.lit(1)).try_cast("int"), F.lit(-1)),
        "before": _char_class(F.right(before, F.lit(1))),
        "behind": _char_class(span["behind"]),
        "hint": before.rlike(HINTS).cast("int"),
    }


#: Generators are numbered: those of the base like their kinds, wider ones that many places behind.
FEATURES = ("generator", "digits", "size", "separators", "opens", "first", "before", "behind", "hint")
_CANDIDATE = "struct<kind:int,start:int,end:int,base:boolean,valid:boolean,features:array<int>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id _text _spans``: overlapping candidates of all generators with their features, as one array per row.

    ``base`` marks matches of the base patterns, ``valid`` those that fulfil their rule.
    """
    text = whole_text(text_col)
    wanted = [(k, True, BASE[name]) for k, name in enumerate(KINDS)] + [(KINDS.index(name), False, p) for name, p in WIDER.items()]
    found = docs.select(col(id_col).alias("_id"), text.alias("_text"))
    found = found.select("*", *[occurrences(F.col("_text"), p).alias(f"_c{n}") for n, (_, _, p) in enumerate(wanted)])

    def described(n: int, kind: int, base: bool) -> Column:
        def one(span: Column) -> Column:
            features = _features(kind if base else kind + len(KINDS), span)
            return F.struct(
                F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), F.lit(base).alias("base"),
                (is_valid(KINDS[kind], span["found"]) if base else F.lit(False)).alias("valid"), F.array(*[features[f].cast("int") for f in FEATURES]).alias("features"),
            )

        return F.transform(f"_c{n}", one).cast(f"array<{_CANDIDATE}>")

    return found.select("_id", "_text", F.concat(*[described(n, k, b) for n, (k, b, _) in enumerate(wanted)]).alias("_spans"))


@dataclass
class Trees:
    """Boosted trees of depth two: ``(feature, threshold, left, right)``, where sides are such nodes or numbers."""

    start: float = 0.0
    trees: list = field(default_factory=list)
    limits: dict[int, float] = field(default_factory=dict)

    def score(self, features: Column) -> Column:
        def value(node) -> Column:
            if isinstance(node, tuple):
                f, at, left, right = node
                return F.when(F.get(features, F.lit(f)) <= at, value(left)).otherwise(value(right))
            return F.lit(float(node))

        total = F.lit(self.start)
        for t in self.trees:
            total = total + value(t)
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        def value(node, rows: np.ndarray) -> np.ndarray:
            if isinstance(node, tuple):
                f, at, left, right = node
                return np.where(rows[:, f] <= at, value(left, rows), value(right, rows))
            return np.full(len(rows), float(node))

        return 1 / (1 + np.exp(-(self.start + sum((value(t, x) for t in self.trees), np.zeros(len(x))))))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 24, rate: float = 0.4, ridge: float = 2.0) -> Trees:
    """Newton boosting of log loss on weighted rows of small numbers."""
    mean = float(np.clip((weight @ y) / weight.sum(), 1e-3, 1 - 1e-3))
    model = Trees(float(np.log(mean / (1 - mean))))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        leaf = float(rate * g[rows].sum() / (h[rows].sum() + ridge))
        best = None
        for f in range(x.shape[1]) if depth else ():
            for at in np.unique(x[rows, f])[:-1].tolist():
                left = rows & (x[:, f] <= at)
                right = rows & ~left
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (left, right))
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, at, left, right)
        if best is None or best[0] <= g[rows].sum() ** 2 / (h[rows].sum() + ridge) + 1e-9:
            return leaf
        return (best[1], int(best[2]), grow(best[3], g, h, depth - 1), grow(best[4], g, h, depth - 1))

    for _ in range(rounds):
        p = model.predict(x)
        model.trees.append(grow(np.ones(len(x), bool), weight * (y - p), weight * p * (1 - p), 2))
    return model


def learn_trees(docs: DataFrame, sample_docs: int | None = None, precision: float = 0.95, support: int = 20, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees and thresholds from the candidates of all documents, or of about ``sample_docs`` of them, chosen by a hash of id and text.

    Matches of the base patterns are examples: those that fulfil their rule (check digits, octets, number of
    digits) are good ones, the others bad. So are matches of the wider patterns that meet a good one of the base: good if
    it is of their kind, bad otherwise; those that meet none are what is to be decided. The trees see format and
    context only. Candidates with equal features are one weighted row; only those rows reach the driver. Half of the
    documents grow the trees; on the other half each generator gets the least score at and above which
    ``precision`` of ``support`` or more examples are good. A wider generator without examples in that half, as that
    of spelt-out addresses, uses the limit of its kind; one with examples but without such a score adds nothing.
    """
    if sample_docs is not None:
        grain = 1 << 30
        share = min(grain, grain * sample_docs // max(docs.count(), 1) + 1)
        place = F.pmod(F.xxhash64(col(id_col), col(text_col)), F.lit(grain))
        # written first: generators would otherwise run over every text, the sample being taken by a filter behind them
        docs = stage(docs.where(place < share).select(col(id_col), col(text_col)), "pii-sample")
    some = candidates(docs, id_col, text_col)
    half = F.pmod(F.xxhash64(F.lit(1), "_text"), F.lit(2))
    seen = some.select(half.alias("half"), F.explode(_examples(F.col("_spans"))).alias("s")).where("s.good IS NOT NULL")
    counted = seen.groupBy("half", F.col("s.features"), F.col("s.good").alias("valid")).agg(F.count("*").alias("n"))
    rows = sorted((r["half"], tuple(r["features"]), int(r["valid"]), r["n"]) for r in stage(counted, "pii-examples").collect())
    fit, check = ([r for r in rows if r[0] == k] for k in (0, 1))
    if len({r[2] for r in fit}) < 2:
        return Trees()
    model = boost(np.array([r[1] for r in fit]), np.array([r[2] for r in fit], float), np.array([r[3] for r in fit], float))
    if not check:
        return model
    scores = model.predict(np.array([r[1] for r in check]))
    for generator in range(2 * len(KINDS)):
        own = sorted(((s, r[2], r[3]) for s, r in zip(scores.tolist(), check) if r[1][0] == generator), reverse=True)
        if own and generator >= len(KINDS):
            model.limits[generator] = 2.0
        good = total = 0
        for k, (s, valid, n) in enumerate(own):
            good, total = good + valid * n, total + n
            last = k + 1 == len(own) or own[k + 1][0] < s
            if last and total >= support and good >= precision * total and s >= 0.5:
                model.limits[generator] = s
    return model


def _examples(spans: Column) -> Column:
    """``features good`` of all candidates of a text; ``good`` is missing where nothing tells."""
    base = F.filter(spans, lambda s: s["base"])
    out = [F.transform(base, lambda s: F.struct(s["features"].alias("features"), s["valid"].alias("good")))]

    def wider(kind: int) -> Column:
        own = F.filter(base, lambda s: s["valid"] & (s["kind"] == kind))
        other = F.filter(base, lambda s: s["valid"] & (s["kind"] != kind))
        good = lambda x, s: F.when(_meets_any(x["own"], s), True).when(_meets_any(x["other"], s), False)
        found = F.filter(spans, lambda s: ~s["base"] & (s["kind"] == kind))
        told = lambda x: F.transform(found, lambda s: F.struct(s["features"].alias("features"), good(x, s).alias("good")))
        return let(F.struct(_bounds(own).alias("own"), _bounds(other).alias("other")), told)

    out += [wider(KINDS.index(name)) for name in WIDER]
    return F.concat(*[o.cast("array<struct<features:array<int>,good:boolean>>") for o in out])


def _bounds(spans: Column) -> Column:
    """Sorted starts and sorted ends of some spans."""
    return F.struct(F.sort_array(F.transform(spans, lambda s: s["start"])).alias("starts"), F.sort_array(F.transform(spans, lambda s: s["end"])).alias("ends"))


def _meets_any(bounds: Column, s: Column) -> Column:
    """Whether a span overlaps one of those of :func:`_bounds`: more begin before its end than end before its start."""
    return below(bounds["starts"], s["end"]) > below(bounds["ends"], s["start"] + 1)


_RANKED = "array<struct<rank:double,start:int,kind:int,end:int>>"


def _best_apart(spans: Column) -> Column:
    """Spans taken best first, each only if it meets none taken before: what gives way itself keeps nothing out.

    Spans are parted where no span reaches across; in each such knot, mostly one span, they are compared with those taken.
    """
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def take(knot: Column) -> Column:
        none = F.array().cast(_RANKED)
        best_first = F.sort_array(F.transform(knot, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
        return F.aggregate(best_first.cast(_RANKED), none, lambda kept, s: F.when(F.exists(kept, lambda o: meets(s, o)), kept).otherwise(F.array_append(kept, s)))

    def knots(x: Column) -> Column:
        n = F.size(x["s"])
        opens = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(x["s"], i - 1)["start"] >= F.get(x["reach"], i - 2)))
        cut = lambda o: F.transform(o, lambda at, j: take(F.slice(x["s"], at, F.coalesce(F.get(o, j + 1), n + 1) - at)))
        return F.flatten(let(opens, cut))

    def reached(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["end"]), lambda end, earlier: F.greatest(end, earlier))
        return F.when(F.size(s) == 0, F.array().cast(_RANKED)).otherwise(let(F.struct(s.alias("s"), reach.alias("reach")), knots))

    return let(F.sort_array(spans), reached)


def find_personal_data(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id _text base spans`` of every row: spans as ``array<struct<start,kind,end>>``, kinds by their place in ``KINDS``.

    ``base`` are the valid matches of the base patterns, each kind leftmost and without overlap. ``spans`` are those and
    every candidate that the trees score at its generator's threshold or above, unless it overlaps a base span or
    one with a better score (of equal ones the first). Places count code points. A
    missing or empty text has no spans. Repeated rows each give a row. Work grows with a text's length and its spans
    times their logarithm; only in a chain of candidates that overlap one another it grows with their square.
    """
    require_columns(docs, [id_col, text_col])
    flat = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    found = candidates(docs, id_col, text_col)
    base = F.sort_array(F.transform(F.filter("_spans", lambda s: s["base"] & s["valid"]), flat))

    def limit_of(s: Column) -> Column:
        out = F.lit(2.0)
        for generator in range(2 * len(KINDS)):
            at = trees.limits.get(generator, trees.limits.get(generator % len(KINDS)))
            if at is not None:
                out = F.when(F.get(s["features"], F.lit(0)) == generator, F.lit(float(at))).otherwise(out)
        return out

    found = found.select("_id", "_text", "_spans", base.alias("base"))
    if not trees.limits:
        return found.select("_id", "_text", "base", F.col("base").alias("spans"))
    scored = F.transform(
        F.filter("_spans", lambda s: ~(s["base"] & s["valid"])),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), (-trees.score(s["features"])).alias("rank"), limit_of(s).alias("limit")),
    )
    free = lambda bounds: F.filter(scored, lambda s: (-s["rank"] >= s["limit"]) & ~_meets_any(bounds, s))
    alone = _best_apart(let(_bounds(F.col("base")), free))
    return found.select("_id", "_text", "base", F.sort_array(F.concat("base", F.transform(alone, flat))).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: Callable[[Column], Column] | None = None) -> Column:
    """The text with each span replaced, ``[email]`` by default; what overlaps an earlier span is dropped with it."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    mark = mark or (lambda kind: F.get(names, kind))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), mark(s["kind"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, begin, add, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
