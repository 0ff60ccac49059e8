"""Regular-expression matches with their places, in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches whose places are summed one by one; more go block by block, so that the cost stays linear. Also spans of a block that others are held against.
BLOCK = 256
#: Pieces (a match and what lies before it) that the context before a match is taken from: matches have five characters or more.
PIECES = 5


def add_matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]], group: dict[str, int] | None = None, before: int = 0, around: tuple[str, ...] = ()) -> DataFrame:
    """df with a column per name: array of (start, end, text, group) of the leftmost non-overlapping matches of its pattern.

    The names in ``around`` also have before, the ``before`` code points in front of the match, and after, the one behind
    it, from the pieces next to it: cutting them out of the text would walk it from its start for every match.

    Places are code points, end exclusive. What lies between the matches comes from splitting at the same pattern, and
    places are running sums of both lengths. Each pattern comes with the condition under which a text can match at all;
    ``group`` gives the capture group to return for a name (else none). Each step is a projection of its own, as later
    ones use its columns several times.
    """
    group, was = group or {}, df.columns
    strings, ints = F.array().cast("array<string>"), F.array().cast("array<int>")

    def searched(name: str, how: Column) -> Column:
        return F.when(patterns[name][1], how).otherwise(strings)

    def step(make) -> DataFrame:
        return df.withColumns({key: value for name in patterns for key, value in make(name).items()})

    df = step(lambda k: {f"_f_{k}": searched(k, F.regexp_extract_all(text, F.lit(patterns[k][0]), F.lit(0))), f"_b_{k}": searched(k, F.split(text, patterns[k][0], -1)), f"_g_{k}": searched(k, F.regexp_extract_all(text, F.lit(patterns[k][0]), F.lit(group[k]))) if k in group else strings})
    df = step(lambda k: {f"_s_{k}": F.zip_with(F.slice(f"_b_{k}", F.lit(1), F.size(f"_f_{k}")), f"_f_{k}", lambda b, m: F.length(b) + F.length(m))})

    def scan(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("sum"), ints.alias("all"))
        return F.aggregate(values, first, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"] + x)).alias("all")), lambda a: a["all"])

    def ends(sums: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(sums), F.lit(BLOCK)), lambda k: F.slice(sums, k, F.lit(BLOCK)))
        first = F.struct(F.lit(0).alias("sum"), F.array().cast("array<array<int>>").alias("all"))
        many = F.aggregate(blocks, first, lambda a, b: F.struct((a["sum"] + F.aggregate(b, F.lit(0), lambda s, x: s + x)).alias("sum"), F.concat(a["all"], F.array(scan(b, a["sum"]))).alias("all")), lambda a: F.flatten(a["all"]))
        return F.when(F.size(sums) == 0, ints).when(F.size(sums) <= BLOCK, scan(sums, F.lit(0))).otherwise(many)

    df = step(lambda k: {f"_e_{k}": ends(F.col(f"_s_{k}"))})

    def beside(k: str) -> Column:
        def put(_: Column, i: Column) -> Column:
            pieces = [x for j in range(PIECES, 0, -1) for x in (F.get(f"_b_{k}", i - j), F.get(f"_f_{k}", i - j))]
            front = F.concat_ws("", *pieces, F.get(f"_b_{k}", i))
            return F.struct(F.right(front, F.lit(before)).alias("before"), F.left(F.concat_ws("", F.get(f"_b_{k}", i + 1), F.get(f"_f_{k}", i + 1)), F.lit(1)).alias("after"))

        return F.transform(F.col(f"_f_{k}"), put) if k in around else F.transform(F.col(f"_f_{k}"), lambda _: F.struct(F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")))

    def spans(k: str) -> Column:
        zipped = F.arrays_zip(F.col(f"_e_{k}").alias("e"), F.col(f"_f_{k}").alias("f"), F.col(f"_g_{k}").alias("g"), beside(k).alias("a"))
        more = lambda x: (x["a"]["before"].alias("before"), x["a"]["after"].alias("after")) if k in around else ()
        return F.transform(zipped, lambda x: F.struct((x["e"] - F.length(x["f"])).alias("start"), x["e"].alias("end"), x["f"].alias("text"), x["g"].alias("group"), *more(x)))

    df = step(lambda k: {k: spans(k)})
    return df.select(*[f"`{c}`" for c in was], *patterns)


def bound(value: Column, body) -> Column:
    """body(value) with the value made once for a row. A column that a lambda uses would be copied into it, and made anew for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def blocks(spans: Column) -> Column:
    """Spans (structs with start and end first), sorted and cut into blocks of BLOCK: (low: least start, high: greatest end, items)."""

    def cut(ordered: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ordered), F.lit(1)), F.lit(BLOCK)), lambda k: k <= F.size(ordered))
        return F.transform(F.transform(places, lambda k: F.slice(ordered, k, F.lit(BLOCK))), lambda b: F.struct(F.array_min(F.transform(b, lambda y: y["start"])).alias("low"), F.array_max(F.transform(b, lambda y: y["end"])).alias("high"), b.alias("items")))

    return bound(F.sort_array(spans), cut)


def untouched(spans: Column, others: Column, also=None) -> Column:
    """The spans that overlap none of the others (for which ``also(other, span)`` holds): blocks that lie apart from a span are passed over whole.
    """

    def free(of: Column) -> Column:
        def touched(x: Column) -> Column:
            near = lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])
            inside = lambda b: F.exists(b["items"], (lambda y: near(y) & also(y, x)) if also else near)
            return F.exists(of, lambda b: F.when((x["start"] < b["high"]) & (b["low"] < x["end"]), inside(b)).otherwise(False))

        return F.filter(spans, lambda x: ~touched(x))

    return bound(blocks(others), free)


def labelled(kind: str, order: int, spans: Column) -> Column:
    """(order, start, kind, end) of each span."""
    return F.transform(spans, lambda x: F.struct(F.lit(order).alias("order"), x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(spans: str) -> Column:
    return F.sha2(F.col(spans).cast("binary"), 256)
