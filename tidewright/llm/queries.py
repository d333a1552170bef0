"""The queries opN_<name> of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a factorization machine, learnt from the labels that are not held out."""
    from tidewright.llm import toxicity

    docs = _read(spark, sf_dir, "documents")
    machine = toxicity.train(docs, _read(spark, sf_dir, "labels"), _remainder(3) != 1)
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0)
    return toxicity.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op2_recurrent_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a bidirectional gated recurrent network over bytes."""
    from tidewright.llm import langid

    docs = _read(spark, sf_dir, "documents")
    net = langid.train(docs, _remainder(4) != 2)
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    return langid.predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over 3-word shingles at a similarity of 0.85."""
    from tidewright.llm.neardup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), width=3, percent=85).drop("text_hash")


def op3_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of nearly equal bytes by histogram sort."""
    from tidewright.llm.sharding import shard, size_of

    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    sharded = shard(_read(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    return sharded.select("doc_id", size_of().alias("size"), crc.alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by fixed patterns and character Markov models."""
    from tidewright.llm.secrets import scan

    return scan(_read(spark, sf_dir, "documents"))


#: Target weights of op5: domains, languages within a domain, sources within a language; others weigh 1.
MIX_WEIGHTS = {"d0": 3.0, "d1": 2.0, "d0/en": 2.0, "d1/de": 0.5, "d2/en": 4.0, "d0/en/src0": 0.25}


def op5_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, dealt over domains, languages and sources, in up to three epochs."""
    from tidewright.llm.mixing import mix

    # the tables name no domain: sources are dealt to four by their last character
    domain = F.concat(F.lit("d"), F.expr("coalesce(ascii(right(source, 1)), 0) % 4").cast("string"))
    return mix(_read(spark, sf_dir, "documents"), domain, MIX_WEIGHTS, fraction=0.5, max_epochs=3, seed=11)


def op7_indexed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back through the index."""
    from tidewright.llm.warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages"), least=0)


def op8_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark in the documents: one row for each document and passage."""
    from tidewright.llm.decontaminate import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_cross_document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules with cross-document line frequency, one row for each document."""
    from tidewright.llm.quality import judged

    return judged(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


def op10_packed_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written in fixed-width bit packing and read back."""
    import public_tokenizers

    from tidewright.llm.tokenfile import round_trip

    return round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op11_distinct_word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of all documents by a table of distinct marked words, and the texts decoded from them."""
    import public_tokenizers

    from tidewright.llm import pieces

    model = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.decode(pieces.encode(_read(spark, sf_dir, "documents"), model), model)
    return both.select("doc_id", pieces.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings, one row for each row and component, by block Lanczos."""
    from tidewright.llm import whitening

    vectors = _read(spark, sf_dir, "embeddings")
    fitted = whitening.fit(vectors, "vec_id", "embedding", components=16)
    return whitening.long_form(whitening.apply(vectors, fitted, "vec_id", "embedding"), fitted)


def op13_bitmask_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle forms of all documents, and the texts restored from them."""
    from tidewright.llm import infill

    made = infill.transform(_read(spark, sf_dir, "documents"), seed=42, percent=50, spm_percent=80)
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, md5(words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS gram
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM d WHERE len(words) > 2)),
again AS (SELECT doc_id, gram FROM g GROUP BY doc_id, gram HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN again USING (doc_id, gram)) GROUP BY doc_id),
l AS (SELECT doc_id, host, text, unnest(lines) AS line FROM d),
n AS (
  SELECT doc_id, host, text, trim(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line,
         len({WORDS.format("line")}) AS words FROM l),
frequent AS (SELECT host, line FROM n GROUP BY host, line HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 't' || text)) > 20),
gone AS (SELECT doc_id, sum(words) AS n FROM n JOIN frequent USING (host, line) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * removed_words <= 70 * n_words AS kept
FROM m
"""

_WEIGHT = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS.items()) + " ELSE 1.0 END"


def _share(children: str, parent: str, order: str) -> str:
    """SQL that divides budget among the rows of a parent by w, none above cap."""
    w = f"PARTITION BY {parent} ORDER BY cap / w, {order}"
    return f"""(
      SELECT * EXCLUDE (ahead, behind, level, open), least(cap, coalesce(w * first_value(CASE WHEN open THEN level END IGNORE NULLS)
          OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), cap)) AS got
      FROM (SELECT *, cap / w > level AS open FROM (SELECT *, (budget - ahead) / behind AS level FROM (
        SELECT *, coalesce(sum(cap) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS ahead,
               sum(w) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind FROM {children}))))"""


OP5_SQL = f"""
WITH t AS (
  SELECT doc_id, 'd' || (CASE WHEN coalesce(source, '') = '' THEN 0 ELSE ascii(right(source, 1)) END % 4) AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS source, coalesce(text, '') AS text,
         CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT domain, language, source, sum(tokens) AS tokens, CAST(3 * sum(tokens) AS DOUBLE) AS cap FROM t GROUP BY ALL),
whole AS (SELECT least(floor(sum(tokens) * CAST(0.5 AS DOUBLE)), sum(cap)) AS budget FROM leaf),
d1 AS (SELECT domain, sum(cap) AS cap, CAST({_WEIGHT.format("domain")} AS DOUBLE) AS w, any_value(budget) AS budget FROM leaf, whole GROUP BY domain),
s1 AS (SELECT domain, got AS budget FROM {_share("d1", "1", "domain")}),
d2 AS (SELECT domain, language, sum(cap) AS cap, CAST({_WEIGHT.format("(domain || '/' || language)")} AS DOUBLE) AS w, any_value(budget) AS budget
       FROM leaf JOIN s1 USING (domain) GROUP BY domain, language),
s2 AS (SELECT domain, language, got AS budget FROM {_share("d2", "domain", "domain, language")}),
d3 AS (SELECT domain, language, source, tokens, cap, CAST({_WEIGHT.format("(domain || '/' || language || '/' || source)")} AS DOUBLE) AS w, budget
       FROM leaf JOIN s2 USING (domain, language)),
s3 AS (SELECT domain, language, source, CAST(tokens AS BIGINT) AS leaf_tokens, CAST(floor(got + 1e-6) AS BIGINT) AS budget
       FROM {_share("d3", "domain, language", "domain, language, source")}),
e AS (SELECT *, unnest([0, 1, 2]) AS epoch FROM s3),
p AS (
  SELECT doc_id, domain, language, source, tokens, epoch, budget, epoch * leaf_tokens AS start, CAST(epoch * leaf_tokens + coalesce(sum(tokens) OVER (
      PARTITION BY domain, language, source, epoch ORDER BY md5('11-' || epoch || '-' || doc_id), doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position
  FROM t JOIN e USING (domain, language, source))
SELECT doc_id, domain, language, source, tokens, CAST(epoch AS INT) AS epoch, position FROM p WHERE position + tokens <= budget AND start <= budget
"""


_UNITS = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"

OP13_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_UNITS}') AS units,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digits FROM documents),
h AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, {", ".join(f"CAST('0x' || substr(digits, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT doc_id, n, form, text, array_to_string(units[:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_hierarchical_mixing": OP5_SQL, "op9_cross_document_quality": OP9_SQL, "op13_bitmask_infilling": OP13_SQL}
