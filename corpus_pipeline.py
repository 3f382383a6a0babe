"""A corpus from raw documents: toxicity, near duplicates, personal data, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, in their order; other columns are dropped, whatever
their names. In every stage null and empty texts count alike unless said otherwise, texts are taken whole whatever
their length, and an empty table gives an empty one. Rows are never told apart by doc_id, which may be null or shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common, op1_pieces, op4_dedup, op5_mix, op8_pii, op9_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies share so much of their sets of five-word shingles.
PERCENT = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labelled rows of the stage's own input.

    Null and empty texts are scored as texts without evidence. Rows without an id are scored, not learned from. Without
    labels of both kinds, every document has that kind's rate as its score. A score at the threshold is rejected;
    repeated rows share their score, so all stay or all go.
    """
    model = op9_toxic.train(docs, common.table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def clean(batch):
        import pyarrow as pa

        return batch.filter(pa.array(shared.value.score(batch.column(place).to_pylist()) < op9_toxic.THRESHOLD))

    return common.map_arrow(docs, clean, docs.schema, text=place).select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row, row: ids may be null or shared. Written once, so that every reader meets the same keys."""
    return common.materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id (null ids last), of each group of near copies.

    Rows without an id and different texts of one id are documents of their own; rows without words (null, empty, white
    space) link with nothing, and only repeated ones of one id become one. Of repeated rows one stays; among rows of
    the smallest id, that of the smaller text hash does.
    """
    rows = keyed(docs)
    groups = op4_dedup.near_duplicates(rows, PERCENT, id_col="row")
    own = rows.select("row", "doc_id", F.xxhash64("text").alias("digest")).join(groups, "row")
    words = F.col("n_shingles") > 0
    group = [F.when(words, F.col("component_id")).alias("group"), *(F.when(~words, F.col(c)).alias(f"same_{c}") for c in ("doc_id", "digest")), F.when(~words & F.col("doc_id").isNull(), F.col("row")).alias("same_row")]
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "row")).alias("first")
    kept = own.groupBy(*group).agg(first).select("first.row")
    return rows.join(kept, "row").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the names of their kinds; n_chars follows the new text.

    Null texts stay null, with null n_chars; empty ones stay empty. Every row stays, repeated rows and rows without an
    id too. Where spans overlap, the first names the whole.
    """
    return op8_pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes of it: none, one or two.

    Texts without words have size 0 and are never taken. A null source is a source of its own. Repeated rows stand next
    to each other in the seeded order and are taken one by one; rows without an id are ordered by their text.
    """
    rows = keyed(docs)
    taken, _, _ = op5_mix.mix(rows, "row", op5_mix.words(F.col("text")), F.col("source"), same=F.col("text"), order=("doc_id", "text"))
    copies = taken.where("taken > 0").select("row", F.expr("cast(taken div size as int)").alias("copies"))
    return rows.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text, and digests of them and of what they decode to.

    Null and empty texts have no pieces and decode to the empty text. One row for each row, repeated or without an id.
    """
    both = op1_pieces.encode(docs, read_back=True)
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: Trained models and sketches have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    with common.Scratch(spark) as tables:
        for name, stage in STAGES[:-1]:
            docs = tables.write(stage(spark, docs, sf_dir), name)
        tables.keep(name)  # the last stage reads it
        return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
