"""Document fingerprints by SimHash, with DataFrame functions only.

A term is a word with its successor; its weight is its length in bytes, at most 16. Every occurrence
of a term votes with its weight, for or against each of the 64 bits of its hash; a bit is 1 if more
than half of the weight votes for it. Two 32-bit counters share a long, so 32 sums do for 64 bits;
they hold votes of a weight below 2^32, that is texts of up to 2^28 words; a longer one is an error.

Search uses permuted block tables: the fingerprint is cut into six blocks; fingerprints within radius
3 agree in three blocks at least, so the tables, one for each choice of 6 - radius blocks, find them
all by an equi-join on the chosen blocks. A pair is reported by the first table that holds it only.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovespark.llm.common import range_parts, with_text, written

PAIR = (1 << 32) + 1  # the lowest bit of either counter
LOW = (1 << 32) - 1
BLOCKS = (11, 11, 11, 11, 10, 10)  # bits, from the lowest


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x00-\\x20]+"), lambda w: w != "")


def votes(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, fp): the fingerprints of the texts, one for each value of keys; texts of equal keys must be equal."""
    listed = texts.select(*keys, words_of(F.col(text)).alias("_w"))
    terms = listed.select(*keys, F.explode_outer(F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))).alias("b"))).alias("_t"))
    hashed = terms.select(
        *keys,
        F.xxhash64(F.lit(5), F.col("_t.a"), F.col("_t.b")).alias("_h"),
        F.when(F.col("_t.a").isNull(), F.lit(0)).otherwise(F.least(F.octet_length("_t.a") + F.coalesce(F.octet_length("_t.b"), F.lit(0)), F.lit(16))).cast("long").alias("_weight"),
    )
    sums = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(PAIR)) * F.col("_weight")).alias(f"_s{i}") for i in range(32)]
    counted = hashed.groupBy(*keys).agg(F.sum("_weight").alias("_all"), *sums)
    fits = F.when(F.col("_all") <= LOW, F.col("_all")).otherwise(F.raise_error(F.lit("text of too many words")).cast("long"))
    counted = counted.withColumn("_all", fits)
    bits = [F.when(2 * F.col(f"_s{i}").bitwiseAND(F.lit(LOW)) > F.col("_all"), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(32)]
    bits += [F.when(2 * F.shiftrightunsigned(f"_s{i}", 32) > F.col("_all"), F.lit((1 << (i + 32)) - (1 << 64) * (i == 31))).otherwise(F.lit(0).cast("long")) for i in range(32)]
    return counted.select(*keys, reduce(Column.bitwiseOR, bits).alias("fp"))


def hex64(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(x: str, y: str) -> Column:
    """1 less the share of differing bits."""
    return 1 - F.bit_count(F.col(x).bitwiseXOR(F.col(y))) / F.lit(64.0)


def _masks() -> list[int]:
    at, out = 0, []
    for n in BLOCKS:
        m = ((1 << n) - 1) << at
        out.append(m - (1 << 64) if m >> 63 else m)
        at += n
    return out


def within(queries: DataFrame, rows: DataFrame, radius: int = 3) -> DataFrame:
    """(q, fp) for every fingerprint fp of rows within the Hamming radius of the fingerprint q of queries, by permuted block tables.

    Both take distinct fingerprints in a column fp; radius is 5 at most. Equal ones are included.
    """
    if not 0 <= radius < len(BLOCKS):
        raise ValueError(f"radius must lie in 0..{len(BLOCKS) - 1}")
    blocks = _masks()
    tables = [reduce(int.__or__, c) for c in combinations(blocks, len(blocks) - radius)]
    table = F.explode(F.array(*[F.lit(m) for m in tables])).alias("block_table")
    key = F.col("fp").bitwiseAND(F.col("block_table")).alias("key")
    q = queries.select("fp", table).select(F.col("fp").alias("q"), "block_table", key)
    r = rows.select("fp", table).select("fp", "block_table", key)
    differs = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.lit(None).cast("long")
    for m in reversed(tables):
        first = F.when(differs.bitwiseAND(F.lit(m)) == 0, F.lit(m)).otherwise(first)
    return q.join(r, ["block_table", "key"]).where(F.bit_count(differs) <= radius).where(first == F.col("block_table")).select("q", "fp")


def with_next(docs: DataFrame, rows_each: int = 1500) -> DataFrame:
    """part and pos (which name the row), doc_id, th (a hash of the text), text, and next_id, next_th, next_text of the next row by descending doc_id; the last row's next is the first.

    Rows are dealt by ranges of doc_id and sorted within each. The ranges follow quantiles of doc_id,
    then equal widths, so their number grows with the table and none is long. The top row of a range
    also goes to the range before it (in this order) as a donor. Rows that share a doc_id are ordered by th.
    """
    base = with_text(docs).withColumn("th", F.xxhash64("text"))
    ids = docs.select("doc_id")
    placed = range_parts(ids, "doc_id", rows_each)
    tops = written(placed(ids).groupBy("coarse", "part").agg(F.max("doc_id").alias("top")), "tops")
    firsts = tops.groupBy("coarse").agg(F.min("part").alias("low")).select("coarse", F.lead("low").over(Window.orderBy("coarse")).alias("above"), F.min("low").over(Window.partitionBy(F.lit(0))).alias("lowest"))
    above = F.lead("part").over(Window.partitionBy("coarse").orderBy("part"))
    gives = tops.select("coarse", "top", above.alias("up")).join(F.broadcast(firsts), "coarse").select("top", F.coalesce("up", "above", "lowest").alias("part"))
    rows = placed(base).select("part", "doc_id", "th", "text", F.lit(False).alias("donor"))
    donors = base.join(gives, F.col("doc_id") == F.col("top")).select("part", "doc_id", "th", "text", F.lit(True).alias("donor"))
    order = Window.partitionBy("part").orderBy("donor", F.desc("doc_id"), F.desc("th"))
    following = [F.lead(c).over(order).alias(a) for c, a in (("doc_id", "next_id"), ("th", "next_th"), ("text", "next_text"))]
    return rows.union(donors).select("part", F.row_number().over(order).alias("pos"), "doc_id", "th", "text", "donor", *following).where("not donor").drop("donor")


def fingerprints_with_edits(docs: DataFrame, radius: int = 3, query_every: int = 20) -> DataFrame:
    """One row for each row of docs (doc_id long, text string): its fingerprint and that of its edited text.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all,
    of the next row by descending doc_id. near_within counts, for rows whose doc_id query_every
    divides, the rows whose fingerprint lies within radius bits, itself included; else it is null.
    Null texts count as empty; a text without words has fingerprint 0; rows that repeat doc_id and
    text come back as often as they stand; an empty table gives no rows; other columns are ignored.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    texts = with_next(docs).withColumn("n_chars", F.char_length("text"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    key = ["part", "pos", "doc_id", "th", "next_id", "next_th", "n_chars"]
    texts = texts.select(*key, "text", edited.alias("edited"))
    sides = texts.select(*key, F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("s"))
    voted = votes(sides.select(*key, "edited_sha256", "s.side", "s.text"), [*key, "edited_sha256", "side"])
    voted = written(voted, "simhash-votes")
    own = voted.where("side = 0").select(*key, "edited_sha256", "fp")
    other = voted.where("side = 1").select("part", "pos", F.col("fp").alias("edited_fp"))
    both = own.join(other, ["part", "pos"])
    following = own.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.max("fp").alias("next_fp"))
    both = both.join(following, F.col("next_id").eqNullSafe(F.col("d")) & (F.col("next_th") == F.col("t")), "left").drop("d", "t")
    classes = own.groupBy("fp").agg(F.count("*").alias("rows"), F.max(F.coalesce(F.col("doc_id") % query_every == 0, F.lit(False))).alias("asked"))
    classes = written(classes, "simhash-classes")
    found = within(classes.where("asked"), classes, radius).join(classes.select("fp", "rows"), "fp").groupBy("q").agg(F.sum("rows").alias("near_within"))
    out = both.join(found, F.col("fp") == F.col("q"), "left")
    return out.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        hex64("fp").alias("fingerprint"),
        hex64("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        F.coalesce(likeness("fp", "next_fp"), F.lit(0.0)).alias("near_next"),
        F.when(F.col("doc_id") % query_every == 0, F.col("near_within")).alias("near_within"),
    )
