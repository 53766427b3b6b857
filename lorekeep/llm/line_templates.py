"""Recurring line templates across documents, in DataFrame functions only.

A fixed-depth parse tree deals lines by token count and leading tokens (those
with digits count as variable).  Two kinds of templates are read off the tree:

* the line with its variable-looking fields (whatever holds a digit or an @)
  masked, and
* in each leaf, the tokens that many texts share at a position, the other
  positions being variable fields.  A leaf may hold several: "many" is taken at
  rising levels, up to nearly all of the leaf's texts.

A template is dropped when it recurs in ``least`` or more different
surroundings: different lines before it and different lines after it (at a
text's border only the other side counts; blank lines are passed over).  The
lines of a recurring block surround each other, so the lines around the whole
block count as well, except in texts that are recurring lines for the most
part.  So lines that recur only because a whole document was copied stay, for
the near-duplicate step to treat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.llm.common import release, settle, small

#: Tokens that look variable: numbers and whatever holds a digit, addresses.
VARIABLE = r"\S*[0-9@]\S*"


def _tree(docs: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """A row per line that is not blank: its document's key, place, size, hash, leaf, masked form and neighbours' hashes.

    Tokens are what single spaces part.  Neighbours are the nearest lines that are not blank.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.split(F.col(text_col).cast("string"), "\n").alias("lines"))
    full = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("line"))), lambda s: s["line"].rlike(r"\S"))
    rows = rows.select("id", "th", full.alias("lines")).withColumn("hashes", F.transform("lines", lambda s: F.xxhash64(s["line"])))
    at = F.transform("lines", lambda s, i: F.struct(s["pos"].alias("pos"), s["line"].alias("line"), F.get("hashes", i).alias("h"), F.get("hashes", i - 1).alias("before"), F.get("hashes", i + 1).alias("after")))
    rows = rows.select("id", "th", F.explode(at).alias("x")).select("id", "th", "x.*")
    rows = rows.withColumn("masked", F.when(F.regexp_like("line", F.lit("[0-9@]")), F.regexp_replace("line", VARIABLE, "<*>")).otherwise(F.col("line")))
    rows = rows.withColumn("n", F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1)
    return rows.select(
        "id",
        "th",
        "pos",
        "n",
        F.length("line").alias("size"),
        "h",
        "masked",
        F.xxhash64("n", F.substring_index("masked", " ", depth)).alias("leaf"),
        F.xxhash64("masked").alias("mask"),
        F.coalesce("before", "after").alias("before"),
        F.coalesce("after", "before").alias("after"),
    )


def _surroundings(uses: DataFrame, least: int) -> DataFrame:
    """Templates with at least ``least`` different lines before and after; uses: tpl, before, after."""
    sides = uses.select("tpl", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("h")), F.struct(F.lit(1).alias("side"), F.col("after").alias("h")))).alias("s")).select("tpl", "s.side", "s.h")
    counts = sides.distinct().groupBy("tpl", "side").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.groupBy("tpl").agg(F.count("*").alias("sides")).where("sides = 2").select("tpl")


def _around_blocks(lines: DataFrame, least: int) -> DataFrame:
    """(th, pos, mask, before, after), settled: lines around the block of recurring lines next to or about each line.

    A line recurs here if ``least`` different texts hold it.  Each text counts
    once, however often it was copied; texts with recurring lines for over half
    of their characters are left out, being copies themselves.
    """
    wide = lines.groupBy("mask").agg(F.count("*").alias("c"), F.min("th").alias("t0"), F.max("th").alias("t1")).where((F.col("c") >= least) & (F.col("t0") != F.col("t1"))).select("mask")
    wide = settle(wide, "wide")
    texts = lines.join(small(wide), "mask").select("mask", "th").distinct().groupBy("mask").agg(F.count("*").alias("texts")).where(F.col("texts") >= least)
    recurring = settle(texts.select("mask", F.lit(True).alias("recurs")), "recurring")
    held = settle(lines.join(small(recurring), "mask").select("th").distinct(), "held")
    rows = lines.select("th", "pos", "size", "h", "mask").join(small(held), "th", "left_semi").dropDuplicates(["th", "pos"])
    rows = rows.join(small(recurring), "mask", "left").withColumn("alone", F.when(F.col("recurs").isNull(), F.col("h")))
    text = W.partitionBy("th")
    rows = rows.withColumn("of", F.sum("size").over(text)).withColumn("again", F.sum(F.when(F.col("recurs"), F.col("size")).otherwise(0)).over(text))
    for side, order in (("b", F.col("pos").asc()), ("a", F.col("pos").desc())):
        rows = rows.withColumn(side, F.last("alone", ignorenulls=True).over(text.orderBy(order).rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.where((F.col("again") * 2 <= F.col("of")) & (F.col("b").isNotNull() | F.col("a").isNotNull()))
    around = settle(rows.select("th", "pos", "mask", F.coalesce("b", "a").alias("before"), F.coalesce("a", "b").alias("after")), "around")
    release(wide, recurring, held)
    return around


def _forms(lines: DataFrame, least: int, depth: int, constant_share: float, min_constant: float) -> DataFrame:
    """(mask, tpl), settled: the templates with variable words that each masked line has, in leaves with several masked lines.

    A token is constant if enough different texts of the leaf have it at its
    position.  Where nearly all have it, ``min_constant`` of a line's tokens
    must be constant; at lower levels so must that share of those after the
    leading ones, which all lines of a leaf have in common.
    """
    leaves = lines.groupBy("leaf", "mask").agg(F.count("*").alias("c"), F.min("th").alias("t0"), F.max("th").alias("t1"))
    leaves = leaves.groupBy("leaf").agg(F.sum("c").alias("c"), F.count("*").alias("kinds"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    leaves = settle(leaves.where((F.col("c") >= least) & (F.col("kinds") >= 2) & (F.col("t0") != F.col("t1"))).select("leaf"), "leaves")
    in_leaf = settle(lines.join(small(leaves), "leaf").select("leaf", "th", "mask", "n", "masked").distinct(), "in-leaf")
    texts = in_leaf.select("leaf", "th").distinct().groupBy("leaf").agg(F.count("*").alias("texts"))
    texts = settle(texts.where(F.col("texts") >= least), "texts")
    words = in_leaf.join(small(texts), "leaf").select("leaf", "th", F.posexplode(F.split("masked", " ")).alias("p", "w"))
    support = words.distinct().groupBy("leaf", "p", "w").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    kinds = in_leaf.select("leaf", "mask", "n", "masked").distinct().join(small(texts), "leaf")
    tokens = kinds.select("leaf", "mask", "n", "texts", F.posexplode(F.split("masked", " ")).alias("p", "w")).join(support, ["leaf", "p", "w"])
    tokens = tokens.groupBy("leaf", "mask", "n", "texts").agg(F.sort_array(F.collect_list(F.struct("p", "w", "c"))).alias("tokens"))
    top = F.ceil(F.col("texts") * constant_share).cast("long")
    steps = F.filter(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: (F.lit(least) * F.pow(F.lit(4), j)).cast("long")), lambda t: t < top)
    tokens = tokens.withColumn("top", top).withColumn("level", F.explode(F.array_append(steps, top)))
    tokens = tokens.withColumn("fixed", F.filter("tokens", lambda x: x["c"] >= F.col("level")))
    needed = F.when(F.col("level") == F.col("top"), F.col("n") * min_constant).otherwise(depth + (F.col("n") - depth) * min_constant)
    fixed = tokens.where(F.size("fixed") >= F.greatest(needed, F.lit(depth + 1)))
    forms = settle(fixed.select("mask", F.xxhash64("leaf", F.transform("fixed", lambda x: F.struct(x["p"], x["w"]))).alias("tpl")).distinct(), "forms")
    release(leaves, in_leaf, texts)
    return forms


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 4, depth: int = 3, min_tokens: int = 3, min_chars: int = 12, constant_share: float = 0.95, min_constant: float = 0.5) -> DataFrame:
    """(id, th, pos): the lines to drop.  th is the hash of the text, pos the line's number from 0.

    Lines under ``min_tokens`` tokens or ``min_chars`` characters are no templates.
    The result is settled; the table of lines, larger than the texts, is gone by then.
    """
    every = settle(_tree(docs, id_col, text_col, depth), "lines")
    lines = every.where((F.col("n") >= min_tokens) & (F.col("size") >= min_chars))
    often = lines.groupBy("mask").agg(F.count("*").alias("c"), F.min("before").alias("b0"), F.max("before").alias("b1"), F.min("after").alias("a0"), F.max("after").alias("a1"))
    often = settle(often.where((F.col("c") >= least) & (F.col("b0") != F.col("b1")) & (F.col("a0") != F.col("a1"))).select(F.col("mask").alias("tpl")), "often")
    masks = _surroundings(lines.join(small(often), lines["mask"] == often["tpl"]).select("tpl", "before", "after"), least)
    around = _around_blocks(every, least)
    masks = masks.unionByName(_surroundings(around.select(F.col("mask").alias("tpl"), "before", "after"), least))

    # Leaves whose lines differ after masking may hold templates with variable words.
    forms = _forms(lines, least, depth, constant_share, min_constant)
    for uses in (lines, around):
        good = _surroundings(uses.join(small(forms), "mask").select("tpl", "before", "after"), least)
        masks = masks.unionByName(forms.join(good, "tpl", "left_semi").select(F.col("mask").alias("tpl")))
    masks = settle(masks.distinct(), "masks")
    dropped = settle(lines.join(small(masks), lines["mask"] == masks["tpl"], "left_semi").select("id", "th", "pos").distinct(), "dropped")
    release(every, often, around, forms, masks)
    return dropped


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **tuning) -> DataFrame:
    """docs with the recurring lines taken out of the text, plus n_lines and n_dropped.

    A null text stays null with no lines; an empty text has one empty line;
    repeated rows are treated alike, null ids are kept; other columns pass
    through (n_lines and n_dropped replace columns of these names); an empty
    table gives none.
    """
    docs = docs.drop("n_lines", "n_dropped")
    dropped = recurring_lines(docs, id_col, text_col, **tuning)
    gone = dropped.groupBy("id", "th").agg(F.sort_array(F.collect_list("pos")).alias("__gone")).withColumnsRenamed({"id": "__id", "th": "__th"})
    named = docs.withColumn("__key", F.xxhash64(F.col(text_col).cast("string")))
    joined = named.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__th")), "left")
    lines = F.split(F.col(text_col).cast("string"), "\n")
    # What lies between neighbouring dropped lines is cut out in slices, so that the work is linear in the lines.
    ends = F.concat(F.array(F.lit(-1)), F.col("__gone"), F.array(F.size(lines)))
    between = F.transform(F.sequence(F.lit(0), F.size("__gone")), lambda k: F.slice(lines, F.get(ends, k) + 2, F.get(ends, k + 1) - F.get(ends, k) - 1))
    kept = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.flatten(between), "\n"))
    return joined.select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"))
