"""What each filter removes under every order of the filters, by counting paths through their subsets.

A state is the set of filters applied so far; an edge applies one more.  What an edge does to the documents
depends on its state alone, not on the order that led there, so all n! orders share n * 2^(n-1) edges.
A forward pass counts the orders that reach a state, a backward pass those that leave it; an edge lies on
forward(before) * backward(after) orders, and its removals with that weight add up to the Shapley sum.
The steps of an order are read from the edges of its path.

Documents are reduced to one row per part, set of failed filters and labels before any order is looked
at, so everything after that first aggregate is small: at most 4 * 2^n rows a part.

A document is a repetition when its text equals that of a document with a smaller id.  Texts meet as
SHA-256 digests; the first id of every digest comes from partial minima, and "is it the first?" is an
equality join on (id, digest), which no frequent text can make hot.

Nulls and special cases: a null text is an empty one, a null part an empty string; a null id is no
repetition, makes none and has no label; rows with the same id count each, and the equal texts of one
id are no repetitions of each other; several labels of one id count if any is 1, labels without id are ignored;
a part without documents has no rows, so an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfeat.runtime import stored

#: All orders of so many filters are listed at most: 5,040 orders a part.
MOST_FILTERS = 7
BLANKS = r"[\x20\x09-\x0D]+"


def too_short(words: Column, least: int = 200) -> Column:
    return F.size(words) < least


def too_repetitive(words: Column, percent: int = 50) -> Column:
    return F.size(F.array_distinct(words)) * F.lit(100).cast("bigint") < F.size(words) * F.lit(percent).cast("bigint")


def too_loud(text: Column, percent: int = 3) -> Column:
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return capitals * F.lit(100).cast("bigint") > F.length(text) * F.lit(percent).cast("bigint")


def has_symbols(text: Column, symbols: str = "#$%&*|") -> Column:
    return F.length(F.translate(text, symbols, "")) < F.length(text)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def text_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest and the failures A to D of every whole text; texts are read once, here."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"))
    return rows.withColumn("words", words_of(F.col("text"))).select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        too_short(F.col("words")).alias("A"), too_repetitive(F.col("words")).alias("B"),
        too_loud(F.col("text")).alias("C"), has_symbols(F.col("text")).alias("D"),
    )


def with_repetitions(rows: DataFrame, out: str = "E") -> DataFrame:
    """Add whether a row's digest occurs under a smaller id; all ``rows`` have one."""
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    return rows.join(firsts, ["doc_id", "digest"], "left").withColumn(out, F.col("_first").isNull()).drop("_first")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``good`` and ``toxic`` (0 or 1) from labels (doc_id, quality, toxic)."""
    one = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return rows.join(one, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def cells(rows: DataFrame, filters: list[str]) -> DataFrame:
    """part, failed (bit k: filter k), good, toxic, n: the table all orders are worked out from."""
    failed = reduce(lambda a, b: a + b, (F.col(f).cast("int") * (1 << k) for k, f in enumerate(filters)))
    return rows.groupBy("part", failed.alias("failed"), "good", "toxic").agg(F.count(F.lit(1)).alias("n"))


def path_counts(n: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders through that edge) of all edges of the subset lattice of ``n`` filters."""
    states = sorted(range(1 << n), key=int.bit_count)
    reaching, leaving = dict.fromkeys(states, 0), dict.fromkeys(states, 0)
    reaching[0] = leaving[(1 << n) - 1] = 1
    steps = [(s, k) for s in states for k in range(n) if not s >> k & 1]
    for s, k in steps:
        reaching[s | 1 << k] += reaching[s]
    for s, k in reversed(steps):
        leaving[s] += leaving[s | 1 << k]
    return [(s, k, reaching[s] * leaving[s | 1 << k]) for s, k in steps]


def edges(cells: DataFrame, n: int) -> DataFrame:
    """One row per part and edge (``state``, ``k``): what applying filter ``k`` after ``state`` does there, and
    ``shapley``: the filter's removals over all orders."""
    state, k, failed, docs = F.col("state"), F.col("k"), F.col("failed"), F.col("n")
    bit = F.call_function("shiftleft", F.lit(1), k)
    fails, earlier = failed.bitwiseAND(bit) != 0, failed.bitwiseAND(state) != 0

    def total(condition: Column, value: Column = docs) -> Column:
        return F.sum(F.when(condition, value).otherwise(0))

    possible = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(k).alias("k"), F.lit(p).cast("bigint").alias("paths")) for s, k, p in path_counts(n)]))
    per_edge = cells.select("*", possible.alias("edge")).select("part", "failed", "good", "toxic", "n", "edge.*").groupBy("part", "state", "k", "paths").agg(
        total(~earlier & ~fails).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"),
        total(failed == bit).alias("unique_fails"), total(fails & ~earlier, docs * F.col("good")).alias("good_lost"),
        total(fails & ~earlier, docs * F.col("toxic")).alias("toxic_lost"),
    )
    sums = per_edge.groupBy("part", "k").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"))
    return per_edge.join(sums, ["part", "k"])


def orders(edges: DataFrame, filters: list[str]) -> DataFrame:
    """One row per part, order of the filters and step, read from the edges of the order's path."""
    steps = []
    for order in permutations(range(len(filters))):
        state = 0
        for step, k in enumerate(order, 1):
            steps.append(("".join(filters[j] for j in order), step, state, k))
            state |= 1 << k
    # As many rows as orders times filters, whatever the documents.
    paths = edges.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, k int")
    return edges.join(F.broadcast(paths), ["state", "k"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_failures(rows: DataFrame, filters: list[str]) -> DataFrame:
    """The audit of any table with ``part``, ``good``, ``toxic`` and one boolean column per filter."""
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")
    # A few rows per part, written once: edges and orders both start from them.
    small = stored(cells(rows, filters), "filter-cells")
    return orders(edges(small, len(filters)), filters)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E on documents (doc_id, text, lang) and labels (doc_id, quality, toxic)."""
    rows = stored(text_failures(docs), "filter-failures")
    known = with_labels(with_repetitions(rows.where("doc_id IS NOT NULL")), labels)
    # Rows without id need no join, in which they would all meet in one task.
    others = rows.where("doc_id IS NULL").withColumns({"E": F.lit(False), "good": F.lit(0), "toxic": F.lit(0)})
    return audit_failures(known.unionByName(others), ["A", "B", "C", "D", "E"])
