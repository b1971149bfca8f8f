"""Operator 4, exact dedup by content-defined chunk recipes. DataFrame functions only: no Python runs on executors.

A text without its ASCII white space is cut where its own characters say so, letters and digits of any common script; only
where MOST characters have no boundary is it cut at their end. A chunk's
identifier is a 64-bit hash; identifiers are verified by comparing the SHA-256 digests of all chunks that carry them,
and one that stands for several contents is told apart by the digest. Two texts are equal when their ordered identifier
lists are. Long texts are read once and never shuffled: only identifiers move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

#: Chunks have LEAST to MOST characters and end after a boundary of character classes where there is one.
LEAST, MOST = 256, 2048
#: Scripts beyond ASCII as (first, last, step, width): of every step characters, width are of the first class and the next width of the
#: second, so that both hold like shares of alphabets, syllables and ideographs.
SCRIPTS = ((0x00C0, 0x0FFF, 0x20, 0x08), (0x3040, 0x30FF, 0x20, 0x08), (0x4E00, 0x9FFF, 0x800, 0x200), (0xAC00, 0xD7A3, 0x400, 0x100))


def _beyond_ascii(place: int) -> str:
    return "".join(rf"\x{{{a + place * width:X}}}-\x{{{a + place * width + width - 1:X}}}" for first, last, step, width in SCRIPTS for a in range(first, last, step))


BOUNDARY = rf"(?:(?<=[aeiouAEIOU0-3][n-tN-T4-7][a-iA-I2-5])|(?<=[^\x00-\x7F])(?<=[{_beyond_ascii(0)}][{_beyond_ascii(1)}]))"
CHUNK = rf"(?s).{{{LEAST},{MOST}}}?{BOUNDARY}|.{{1,{MOST}}}"
#: A group's rows are dealt to so many parts, or as many as there are shuffle partitions, so that no task gets a hot group whole.
SALTS = 64


def chunked(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty and blank texts are equal to each other. Of equal texts the row with most code points
    in its original text stays, then the smallest doc_id; a null doc_id comes last. Rows that repeat the same doc_id and text
    are all `kept` when that doc_id is the one that stays. Other columns are ignored. An empty table gives an empty result.
    id_bits shortens identifiers, to test that the verification tells colliding chunks apart.
    """
    spark, ws = docs.sparkSession, common.shared_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("n_cp"), F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").alias("norm"))
    cut = norm.select("doc_id", "n_cp", F.sha2(F.col("norm"), 256).alias("sha"), chunked(F.col("norm")).alias("chunks"))
    ident = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - id_bits) if id_bits < 64 else F.xxhash64(c)
    base = common.stored(
        cut.select("doc_id", "n_cp", "sha", F.transform("chunks", ident).alias("ids"), F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("digests")),
        f"{ws}/recipes",
    )
    pairs = base.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).select("c.ids", "c.digests").distinct()
    bad = pairs.groupBy("ids").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("digests")).alias("all")).where("n > 1").select("ids", "all")
    bad = common.stored(bad, f"{ws}/collisions")
    key = ["ids"]
    if not bad.isEmpty():  # identifiers that stand for several contents: their chunks get the content's rank as well
        at = base.select("doc_id", "n_cp", "sha", F.posexplode(F.arrays_zip("ids", "digests")).alias("pos", "c")).select("doc_id", "n_cp", "sha", "pos", "c.ids", "c.digests")
        mended = at.join(bad, "ids").select("doc_id", "n_cp", "sha", F.struct("pos", F.array_position("all", F.col("digests")).alias("rank")).alias("m"))
        mended = mended.groupBy("doc_id", "n_cp", "sha").agg(F.sort_array(F.collect_set("m")).alias("mend"))
        mended = mended.select(F.col("doc_id").alias("m_id"), F.col("n_cp").alias("m_cp"), F.col("sha").alias("m_sha"), "mend")
        same = F.expr("doc_id <=> m_id and n_cp = m_cp and sha = m_sha")
        base = base.join(mended, same, "left").select("doc_id", "n_cp", "sha", "ids", "mend")
        key = ["ids", "mend"]
    recipe = F.struct(*key).alias("recipe")
    salts = max(SALTS, common.shuffle_partitions(spark))
    rows = base.select("doc_id", "n_cp", "sha", recipe, F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    best = F.max(F.struct("n_cp", F.bitwise_not("doc_id").alias("neg")))  # falls as doc_id grows, and never overflows
    parts = rows.groupBy("recipe", "salt").agg(F.count("*").alias("n"), best.alias("best"))
    whole = parts.groupBy("recipe").agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
    by_part = parts.select("recipe", "salt").join(whole, "recipe")
    keep = F.bitwise_not(F.col("best.neg"))
    return rows.join(by_part, ["recipe", "salt"]).select(
        "doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256")
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """docs' rows, all columns, of which exact_dedup keeps one of each group; of rows that repeat a doc_id and text one stays.

    doc_ids that repeat, and null ones, are told apart by their texts; others by the doc_id alone.
    """
    r = common.stored(exact_dedup(docs), f"{common.shared_dir(docs.sparkSession)}/decided").withColumnsRenamed({"doc_id": "own_id", "kept": "own_kept"})
    odd = r.groupBy("own_id").count().where("count > 1 or own_id is null").select("own_id")
    gone = r.where("not own_kept").select("own_id").union(odd).distinct()
    plain = docs.join(gone, docs["doc_id"].cast("long") == gone["own_id"], "left_anti").where(F.col("doc_id").isNotNull())
    if odd.isEmpty():
        return plain
    sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", ""), 256)
    rows = docs.join(odd, docs["doc_id"].cast("long").eqNullSafe(odd["own_id"]), "left_semi").withColumn("own_sha", sha).dropDuplicates(["doc_id", "own_sha"])
    stay = r.where("own_kept").select("own_id", F.col("text_sha256").alias("stay_sha")).distinct()
    rows = rows.join(stay, rows["doc_id"].cast("long").eqNullSafe(stay["own_id"]) & (rows["own_sha"] == stay["stay_sha"]), "left_semi")
    return plain.unionByName(rows.drop("own_sha"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm
  from documents),
k as (
  select doc_id, norm, first_value(doc_id) over (partition by norm order by n_cp desc, doc_id) as keep_id,
         count(*) over (partition by norm) as group_size
  from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from k
"""
