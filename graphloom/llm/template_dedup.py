"""Line deduplication by a log-template tree of fixed depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import broadcast_if_small, discard, materialize

FIELD = "<*>"
LEADING = 3  # tokens that lead to a leaf, below the level of token counts
PARTS = 8  # pieces of a line, of which a template leaves two open
WORDY = 5  # constant tokens from which two documents are enough
FEW_TIMES = 8  # occurrences that a shorter template needs


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, pos, line, leaf, wordy) of lines that are not blank; tokens with a digit become variable
    fields. Texts without odd white space, and lines without digits, skip the patterns for them."""
    odd = F.lit(False)
    for mark in ("\t", "\x0b", "\f", "\r", "  "):
        odd = odd | F.col("text").contains(mark)
    even = F.when(odd, F.regexp_replace("text", r"[\t\x0B\f\r ]{2,}|[\t\x0B\f\r]", " ")).otherwise(F.col("text"))
    cut = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).select("doc", F.posexplode(F.split(even, "\n")).alias("pos", "line"))
    cut = cut.select("doc", "pos", F.trim("line").alias("line")).where(F.col("line") != "")
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", r"[^ 0-9]*[0-9][^ ]*", FIELD)).otherwise(F.col("line"))
    cut = cut.select("doc", "pos", masked.alias("line"))
    tokens = F.size(F.split("line", " "))
    constant = F.when(F.col("line").contains(FIELD), F.size(F.filter(F.split("line", " "), lambda t: t != FIELD))).otherwise(tokens)
    leaf = F.xxhash64(tokens, F.substring_index("line", " ", LEADING))
    return cut.select("doc", "pos", "line", leaf.alias("leaf"), (constant >= WORDY).alias("wordy"))


def _templates(lines: DataFrame) -> DataFrame:
    """(leaf, h, lo, hi, c, template, constants) of distinct lines: the line itself, and the templates that leave
    some of its pieces open. A template is a hash, which takes in the leaf and so the first three tokens."""
    tokens = F.split("line", " ")
    n = F.size("t")
    bound = lambda i: F.floor(n * i / PARTS).cast("int")
    piece = lambda i: F.slice("t", bound(i) + 1, bound(i + 1) - bound(i))
    # of the tokens that the leaf does not fix
    fixed = lambda i: F.size(F.filter(F.slice("t", F.greatest(bound(i), F.lit(LEADING)) + 1, F.greatest(bound(i + 1) - F.greatest(bound(i), F.lit(LEADING)), F.lit(0))), lambda t: t != FIELD))
    known = ["leaf", "h", "lo", "hi", "c"]
    cut = lines.withColumn("t", tokens).select(
        *known, n.alias("n"), F.size(F.filter("t", lambda t: t != FIELD)).alias("all"),
        F.array(*[F.xxhash64(F.array_join(piece(i), " ")) for i in range(PARTS)]).alias("p"), F.array(*[fixed(i) for i in range(PARTS)]).alias("k"),
    )

    def template(*open_):
        rest = [F.lit(None).cast("long") if i in open_ else F.col("p")[i] for i in range(PARTS)]
        constants = F.col("all")
        for i in open_:
            constants = constants - F.col("k")[i]
        return F.struct(F.xxhash64("leaf", *rest, *[F.lit(i) for i in open_]).alias("template"), constants.alias("constants"))

    own = template()
    one = F.array(own, *[template(i) for i in range(PARTS)])
    two = F.array(own, *[template(i, j) for j in range(PARTS) for i in range(j)])
    every = F.when(F.col("n") >= PARTS, two).when(F.col("n") >= PARTS // 2, one).otherwise(F.array(own))
    return cut.select(*known, F.explode(F.array_distinct(every)).alias("x")).select(*known, "x.template", "x.constants")


def recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, positions) of lines to drop: they have a template that recurs across documents, and this is
    not the document with its smallest id.

    Equal lines are counted first, so that each distinct line enters the tree once, and only where its
    leaf has others; a line is known by its leaf and its hash, 128 bits together. Templates depend on
    their line alone, so that they are counted by aggregates with partial sums, however many
    lines a leaf holds."""
    lines = _lines(docs.where(F.col(key).isNotNull()), key, text).withColumn("h", F.xxhash64("line"))
    line = ["leaf", "h"]
    narrow = materialize(lines.select("doc", "pos", "leaf", "h", "wordy"), "lines")
    counts = [F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("c")]
    stats = materialize(narrow.groupBy(*line).agg(*counts, F.first("wordy").alias("wordy")), "line-stats")
    leaves = stats.groupBy("leaf").agg(F.count("*").alias("k"), F.min("lo").alias("a"), F.max("hi").alias("b")).where("k > 1 and a <> b")
    leaves = materialize(leaves.select("leaf"), "line-leaves")
    # one text for each distinct line; equal lines have equal texts
    texts = lines.join(broadcast_if_small(leaves, 300_000), "leaf").groupBy(*line).agg(F.min("line").alias("line"), *counts)
    under = materialize(_templates(texts), "line-templates")
    recur = (F.col("keep") != F.col("hi")) & ((F.col("constants") >= WORDY) | (F.col("n") >= FEW_TIMES))
    keep = under.groupBy("template").agg(F.min("lo").alias("keep"), F.max("hi").alias("hi"), F.sum("c").alias("n"), F.min("constants").alias("constants"))
    keep = materialize(keep.where(recur).select("template", "keep"), "line-keep")
    # a sort-merge join at every size; AQE splits a template that many lines have
    of_tree = under.select(*line, "template").join(keep.hint("merge"), "template").groupBy(*line).agg(F.min("keep").alias("keep"))
    lone = stats.join(broadcast_if_small(leaves, 300_000), "leaf", "left_anti")
    lone = lone.where((F.col("lo") != F.col("hi")) & (F.col("wordy") | (F.col("c") >= FEW_TIMES))).select(*line, F.col("lo").alias("keep"))
    drop = materialize(of_tree.unionByName(lone), "line-drop")
    hit = narrow.select("doc", "pos", *line).join(broadcast_if_small(drop, 300_000), line).where(F.col("doc") != F.col("keep"))
    out = materialize(hit.groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("positions")), "line-positions")
    for table in (narrow, stats, leaves, under, keep, drop):
        discard(table)
    return out


def drop_recurring(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines that have a template recurring across documents, except in the document
    with the smallest id, and with the number of dropped lines as ``lines_dropped``.

    The tree leads by the number of tokens, then by three leading tokens to a leaf. Tokens with
    digits are fields. Below the leaf, a line of at least eight tokens is cut into eight pieces, and
    its templates are the line itself and the line with any two pieces left open: about a
    quarter of it, the leading tokens excepted; a line of four to seven tokens leaves one open, a shorter one none.
    A template recurs if lines of two documents have it; one with less than five constant tokens must
    also occur eight times. So a line goes if an earlier document has it, or one that differs
    in open pieces only, whatever other lines there are.

    Blank lines stay, a null text stays null, rows without id are left alone; a text may become empty.
    Rows that repeat an id are one document. Other columns pass through, but a column ``lines_dropped``
    is replaced; columns that begin with ``_dedup_`` are not allowed."""
    if clash := [c for c in docs.columns if c.startswith("_dedup_")]:
        raise ValueError(f"columns {clash} clash")
    positions = recurring_lines(docs, key, text).select(F.col("doc").alias("_dedup_doc"), F.col("positions").alias("_dedup_positions"))
    both = docs.drop("lines_dropped").join(broadcast_if_small(positions, 300_000), F.col(key).cast("bigint") == F.col("_dedup_doc"), "left")
    return _rebuilt(both, [c for c in docs.columns if c != "lines_dropped"], text)


def _rebuilt(both: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The lines are split once, then those at the kept positions are joined again."""
    dropped = F.col("_dedup_positions").isNotNull()
    both = both.withColumn("_dedup_parts", F.when(dropped, F.split(F.col(text), "\n")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_dedup_parts") - 1), F.col("_dedup_positions"))
    rest = F.array_join(F.transform(kept, lambda i: F.element_at("_dedup_parts", i + 1)), "\n")
    new = F.when(dropped, rest).otherwise(F.col(text))
    return both.select(
        *[new.alias(c) if c == text else F.col(c) for c in columns],
        F.when(dropped, F.size("_dedup_positions")).otherwise(0).alias("lines_dropped"),
    )
