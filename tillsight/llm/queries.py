"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.llm.collocation import collocations
from tillsight.llm.common import PIECE_MODEL, documents, id_bucket, labels
from tillsight.llm.divergence import source_divergence
from tillsight.llm.exact_dedup import exact_copies
from tillsight.llm.language import fit_languages, predict_languages
from tillsight.llm.licenses import KNOWN_TEXTS, NOTICES, scan_licenses
from tillsight.llm.mixing import mix
from tillsight.llm.near_dedup import NearParams, near_copies
from tillsight.llm.pieces import encode_texts, model_bytes
from tillsight.llm.quality import quality_verdicts
from tillsight.llm.sharding import shard_documents
from tillsight.llm.suffix_dedup import remove_repeats
from tillsight.llm.toxicity import fit_toxicity, score_toxicity
from tillsight.llm.vector_dedup import near_vectors


def op1_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(id_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit_toxicity(docs, labels(spark, sf_dir).where(~held_out))
    scored = score_toxicity(docs.select("doc_id", held_out.alias("held_out"), "text"), model, F.col("text"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_near_dedup(spark, sf_dir):
    return near_copies(documents(spark, sf_dir), NearParams(words=2))


def op3_exact_dedup(spark, sf_dir):
    return exact_copies(documents(spark, sf_dir))


def op4_mix_sources(spark, sf_dir):
    return mix(documents(spark, sf_dir))


def op5_pieces(spark, sf_dir, model: str = PIECE_MODEL):
    return encode_texts(documents(spark, sf_dir), model_bytes(model), keep=["doc_id"])


def op6_quality_rules(spark, sf_dir):
    return (quality_verdicts(documents(spark, sf_dir), carry=["doc_id"])
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", F.col("p_good")))


def op7_shard_documents(spark, sf_dir):
    return (shard_documents(documents(spark, sf_dir), shards=8)
            .withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int")))


def op8_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(id_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit_languages(docs.where(~held_out))
    return predict_languages(docs.select("doc_id", held_out.alias("held_out"), "text"), model,
                             F.col("text")).drop("text")


def op9_suffix_dedup(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir)).drop("spans")


def op10_license_scan(spark, sf_dir):
    return scan_licenses(documents(spark, sf_dir))


def op11_collocations(spark, sf_dir):
    return collocations(documents(spark, sf_dir))


def op12_source_divergence(spark, sf_dir):
    return source_divergence(documents(spark, sf_dir))


def op13_vector_dedup(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_pieces": op5_pieces,
    "op6_quality_rules": op6_quality_rules,
    "op7_shard_documents": op7_shard_documents,
    "op8_language_id": op8_language_id,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_collocations": op11_collocations,
    "op12_source_divergence": op12_source_divergence,
    "op13_vector_dedup": op13_vector_dedup,
}

#: Code points deleted before texts are compared, as DuckDB's re2 writes them.
_OP3 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST)
"""

_OP4 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(concat_ws(':', '1', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 10))
            ::BIGINT::DOUBLE + 0.5) / 1099511627776.0 AS u
  FROM documents),
c AS (SELECT *, least(length(bin(size)), 64)::BIGINT AS cls FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM c GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
             2.0::DOUBLE * source_size AS cap FROM s),
lv AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
          / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
       FROM w),
t AS (SELECT source, source_size, least(cap, coalesce(
        max(CASE WHEN lvl * weight <= cap THEN lvl END) OVER () * weight, cap)) AS target FROM lv),
k AS (SELECT source, cls, sum(size)::BIGINT AS class_size FROM c GROUP BY source, cls HAVING sum(size) > 0),
r0 AS (SELECT k.source, cls, (target - 2.0::DOUBLE * coalesce(sum(class_size) OVER (PARTITION BY k.source ORDER BY cls DESC
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
          / sum(class_size * cls) OVER (PARTITION BY k.source ORDER BY cls DESC
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rate
       FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
r AS (SELECT source, cls, least(2.0::DOUBLE, coalesce(
        max(CASE WHEN rate * cls::DOUBLE <= 2.0 THEN rate END) OVER (PARTITION BY source) * cls::DOUBLE, 2.0::DOUBLE)) AS expected
      FROM r0),
e AS (SELECT c.*, t.source_size, t.target, CASE WHEN size > 0 THEN coalesce(r.expected, 0.0) ELSE 0.0 END AS expected
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
      LEFT JOIN r ON c.source IS NOT DISTINCT FROM r.source AND c.cls = r.cls),
p AS (SELECT *, floor(expected)::BIGINT AS certain, expected - floor(expected) AS p FROM e),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1.0 - u)) / (p / (1.0 - p)) END AS q,
             target - sum(size * certain) OVER (PARTITION BY source)::DOUBLE AS lacking FROM p),
z AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, size, rn
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS reached FROM q),
m AS (SELECT *, CASE WHEN q IS NOT NULL AND reached + size <= lacking THEN 1 ELSE 0 END AS more FROM z),
g AS (SELECT *, target - sum(size * (certain + more)) OVER (PARTITION BY source)::DOUBLE AS gap FROM m),
f AS (SELECT *, q IS NOT NULL AND more = 0 AND abs(size - gap) < gap AS free FROM g),
l AS (SELECT *, free AND row_number() OVER (PARTITION BY source, free ORDER BY abs(size - gap), q, doc_id, rn) = 1 AS last FROM f)
SELECT doc_id, source, size, source_size, target, certain + more + last::INT AS copies,
       (certain + more + last::INT) * size AS taken
FROM l
"""


def _canonical(x: str) -> str:
    """The canonical form of ``tillsight.llm.licenses`` in DuckDB SQL, stated on its own."""
    steps = [
        (r"(?m)^[^\p{L}\n(©]*(?:copyright\b|\(c\)|©)[^\n]*(?:[0-9]{4}|<year>|all rights reserved)[^\n]*$"
         r"|^[^\p{L}\n]*all rights reserved[^\p{L}\n]*$", " "),
        ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("favour", "favor"),
        ("organis", "organiz"), ("utilis", "utiliz"), ("authoris", "authoriz"), ("https://", "http://"), ("&", " and "),
        ("version ([0-9])", r"v\1"), (r"v([0-9])\.0\b", r"v\1"), (r"[^\p{L}\p{N}]+", " ")]
    out = f"lower(coalesce({x}, ''))"
    for pattern, to in steps:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim({out})"


def _known(texts: dict) -> str:
    rows = [(name, t) for name, many in texts.items() for t in ((many,) if isinstance(many, str) else many)]
    values = ", ".join("('{}', '{}')".format(name, t.replace("'", "''")) for name, t in rows)
    return (f"SELECT digest, min(license) AS license FROM (SELECT license, sha256({_canonical('body')}) AS digest "
            f"FROM (VALUES {values}) AS v(license, body)) GROUP BY digest")


_OP10 = f"""
WITH whole AS ({_known(KNOWN_TEXTS)}), notice AS ({_known(NOTICES)}),
d AS (SELECT row_number() OVER () AS rn, doc_id, text FROM documents),
line AS (SELECT DISTINCT rn, sha256({_canonical('l')}) AS digest
         FROM (SELECT rn, unnest(string_split(text, chr(10))) AS l FROM d) WHERE length(trim(l)) > 0),
found AS (SELECT rn, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
          FROM line JOIN notice USING (digest) GROUP BY rn),
t AS (SELECT rn, doc_id, sha256({_canonical('text')}) AS text_digest FROM d)
SELECT doc_id, text_digest, license, coalesce(notices, '') AS notices
FROM t LEFT JOIN whole ON text_digest = whole.digest LEFT JOIN found USING (rn)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = rf"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS body
               FROM documents),
ws AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(body, '[^\x20\x09]+') AS w FROM piece),
spot AS (SELECT id, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM ws),
run AS (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM spot WINDOW o AS (PARTITION BY id ORDER BY i)),
gram AS (SELECT lang, 1 AS k, w AS phrase FROM run
         UNION ALL SELECT lang, 2, w || ' ' || w2 FROM run WHERE w2 IS NOT NULL
         UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM run WHERE w3 IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM gram GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT lang, k, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS rest
         FROM cand, (VALUES (1), (2)) AS js(j) WHERE j < k),
scored AS (SELECT c.*, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a * y.a) AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head AND x.k = c.j
                       JOIN f y ON y.lang = c.lang AND y.phrase = c.rest AND y.k = c.k - c.j),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(w[j:j + 1], ' ') AS phrase, max(a) AS longer
           FROM cand, (VALUES (1), (2)) AS js(j) WHERE k = 3 GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase AND b.k = 2
         WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS rn, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT rn, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rn) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0)::HUGEINT AS v, coalesce(total, 0)::HUGEINT AS total
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
      LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p
      FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // ((SELECT sum(total) FROM g WHERE g.lang = p.lang)
             + 2 * (SELECT max(v) FROM g WHERE g.lang = p.lang)) AS q FROM p GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
                    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
           ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
         FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
       (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pair
UNION ALL
SELECT lang, source, 'term', item, value,
       (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM term QUALIFY rank <= 10
"""

ORACLES = {
    "op4_mix_sources": _OP4,
    "op10_license_scan": _OP10,
    "op3_exact_dedup": _OP3,
    "op11_collocations": _OP11,
    "op12_source_divergence": _OP12,
}
