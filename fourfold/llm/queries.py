"""The contract queries: each applies one operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.llm.common import table
from fourfold.llm.encoders import public_path

#: The vocabulary of the token queries.
VOCABULARY = "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourfold.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_path(VOCABULARY))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourfold.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), public_path(VOCABULARY))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourfold.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourfold.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def levels():
    """The tree of the mixture over `documents`: domains are made of the sources' numbers."""
    number = F.regexp_extract("source", r"([0-9]+)$", 1).cast("int")
    domain = F.when(number == 0, "bulk").when(number % 2 == 0, "reference").when(number % 2 == 1, "forum").otherwise("other")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


#: Target weights of domains and languages; sources of a language have equal ones.
DOMAINS = {"bulk": 2.0, "reference": 5.0, "forum": 3.0}
LANGUAGES = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}


def weight(path: tuple[str, ...]) -> float:
    return DOMAINS.get(path[0], 1.0) if len(path) == 1 else LANGUAGES.get(path[1], 1.0) if len(path) == 2 else 1.0


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourfold.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), levels(), weight, public_path(VOCABULARY), share=0.8, epochs=3)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourfold.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourfold.llm.chat_format import digests, format_conversations

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(*more.columns).union(more)
    return digests(format_conversations(rows, public_path("byte_bpe_50k.json")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourfold.llm.language_id import languages

    return languages(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourfold.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourfold.llm.url_filter import judged

    return judged(table(spark, sf_dir, "pages"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10's rules say of every page, which SQL can say too."""
    from fourfold.llm.url_filter import RULES, fitting, parts

    host, path = parts(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    return rows.select("page_id", "host", "path", fitting(RULES, F.col("host"), F.col("path")).alias("rule"))


#: The rules, host and path of op10 in SQL.
RULES_SQL = """
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM r),
x AS (SELECT page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0), '') AS path FROM h)
SELECT page_id, host, path, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM x
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"url_rules": url_rules}


def oracle_sql() -> dict[str, str]:
    return {"url_rules": RULES_SQL}
