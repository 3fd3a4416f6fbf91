"""Contract queries: vector search, sharding, chat formatting, centroid clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, exponion, sharding, vptree


def op3_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.read(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20, factor=0.6)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(common.read(spark, sf_dir, "documents"), shards=40)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The text of one more conversation, which looks like marks and escapes itself.
EXTRA = "\\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = chat.Template()
    turns = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(EXTRA).alias("text"))
    turns = turns.unionByName(extra)
    # The read-back works on the formatted text and the segments alone.
    out = chat.format_conversations(turns, template).select("conv_id", "valid", "segments", chat.formatted().alias("whole"))
    out = out.select("conv_id", "valid", "whole", chat.parsed(F.col("whole"), template).alias("turns"), chat.loss_text(template).alias("loss"))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("whole").cast("long").alias("formatted_chars"), "valid",
    )


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), agg AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    string_agg(role || ' ', '' ORDER BY turn, role, text) AS roles,
    sum(length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', ''))
      + length(role) + 16) AS chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars,
  regexp_full_match(roles, '(system )?(user assistant )+') AS valid
FROM agg
"""

def op13_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = exponion.cluster(common.read(spark, sf_dir, "embeddings"), k=16, rounds=3)
    told = exponion.with_inertia(found).withColumn("centroid_sha256", exponion.centroid_digest(centroids))
    return told.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {"op3_vantage_points": op3_vantage_points, "op7_sharding": op7_sharding, "op8_chat": op8_chat, "op13_exponion": op13_exponion}
ORACLE_SQL = {"op8_chat": OP8_SQL}
