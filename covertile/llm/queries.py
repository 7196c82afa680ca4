"""The thin queries ``opN_<name>``: an operator on its whole table with production parameters, and digest columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; found where it is installed, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    packed = pack_documents(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


def op2_media(spark, sf_dir: str) -> DataFrame:
    from .media import read_media, store_texts

    seen = read_media(store_texts(read(spark, sf_dir, "documents")))
    return seen.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op3_topk(spark, sf_dir: str) -> DataFrame:
    from .topk_search import search

    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    done = remove_repeats(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    from .minhash_dedup import link_classes

    return link_classes(read(spark, sf_dir, "documents"), width=2, percent=80)


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT doc_id, CASE WHEN len(x) < 2 THEN x ELSE list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
      AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS v, a AS t FROM both_ways UNION SELECT r.v, b.b FROM r JOIN both_ways b ON r.t = b.a),
c AS (SELECT v, min(t) AS m FROM r GROUP BY v)
SELECT doc_id, len(g)::BIGINT AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept FROM s LEFT JOIN c ON v = doc_id
"""


def op7_pieces(spark, sf_dir: str) -> DataFrame:
    from .sentence_pieces import encode

    coded = encode(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: The rule set of op8.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(read(spark, sf_dir, "pages"), rules)


OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, q, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, h || q AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC, length(h) DESC) AS k
      FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, host, path, m.rule, coalesce(m.v, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""


def op6_quality(spark, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    scored = score(docs, fit(docs, labels.where(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    from .licenses import by_document

    return by_document(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_sql() -> str:
    from .licenses import duckdb_sql

    return duckdb_sql()


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = score(docs, fit(docs, labels.where(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op11_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import staged
    from .mixing import mix, with_sizes

    docs = with_sizes(read(spark, sf_dir, "documents")).select("doc_id", "source", "size")
    mixed = mix(staged(docs, "words"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


#: The same multipliers by sixty steps for every source, and the same roundings.
OP11_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, source IS NULL AS nul, coalesce(source, '') AS src, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size FROM documents),
h AS (SELECT nul, src, size, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT nul, src, sum(size * n)::BIGINT AS total, ([3.0, 1.0, 2.0][(row_number() OVER (ORDER BY nul, src) - 1) % 3 + 1])::DOUBLE AS weight, sum(n) FILTER (size > 0) AS docs, min(size) FILTER (size > 0) AS small, sum(size::DOUBLE * size * n) AS squares FROM h GROUP BY nul, src),
mixed AS (SELECT 1.5 * sum(total)::DOUBLE AS words FROM s),
level AS (SELECT 0 AS k, 0::DOUBLE AS held, sum(weight) AS free FROM s
    UNION ALL SELECT k + 1, coalesce(sum(2 * s.total::DOUBLE) FILTER (2 * s.total * free <= (words - held) * weight), 0), coalesce(sum(weight) FILTER (2 * s.total * free > (words - held) * weight), 0) FROM level, s, mixed WHERE k < 60 GROUP BY k),
t AS (SELECT s.*, s.total::DOUBLE / docs AS mean, CASE WHEN free = 0 OR 2 * s.total * free <= (words - held) * weight THEN 2 * s.total::DOUBLE ELSE (words - held) * weight / free END AS target FROM s, mixed, (SELECT held, free FROM level WHERE k = 60)),
it AS (SELECT nul, src, 0 AS k, CASE WHEN target >= 2 * total THEN ln(2) * mean / small WHEN target < total THEN ln(target / total) * total * mean / squares ELSE 0 END AS lam,
        CASE WHEN target < total THEN ln(target / total) * mean / small ELSE 0 END AS lo, CASE WHEN target < total THEN 0 ELSE ln(2) * mean / small END AS hi FROM t WHERE total > 0
    UNION ALL SELECT nul, src, k + 1, CASE WHEN lam - slope / nullif(curve, 0) > CASE WHEN slope <= 0 THEN lam ELSE lo END AND lam - slope / nullif(curve, 0) < CASE WHEN slope > 0 THEN lam ELSE hi END
            THEN lam - slope / nullif(curve, 0) WHEN abs(slope) <= 1e-13 * goal THEN lam ELSE (CASE WHEN slope <= 0 THEN lam ELSE lo END + CASE WHEN slope > 0 THEN lam ELSE hi END) / 2 END,
        CASE WHEN slope <= 0 THEN lam ELSE lo END, CASE WHEN slope > 0 THEN lam ELSE hi END
        FROM (SELECT it.nul, it.src, k, lam, lo, hi, t.target / mean AS goal, sum(n * (size / mean) * least(2, exp(least(700, lam * size / mean)))) - t.target / mean AS slope,
              sum(CASE WHEN exp(least(700, lam * size / mean)) < 2 THEN n * (size / mean) * (size / mean) * exp(least(700, lam * size / mean)) ELSE 0 END) AS curve
              FROM it JOIN t USING (nul, src) JOIN h USING (nul, src) WHERE k < 60 AND size > 0 GROUP BY it.nul, it.src, k, lam, lo, hi, t.target, mean)),
r AS (SELECT h.*, t.total, t.target, CASE WHEN size = 0 THEN 1.0 WHEN t.target >= 2 * t.total THEN 2.0 ELSE least(2.0, exp(least(700, lam * size / mean))) END AS rate FROM h JOIN t USING (nul, src) LEFT JOIN it ON it.nul = h.nul AND it.src = h.src AND it.k = 60),
u AS (SELECT *, floor(sum(n * rate) OVER (PARTITION BY nul, src ORDER BY size DESC ROWS UNBOUNDED PRECEDING) + 0.5) AS upto FROM r),
c0 AS (SELECT nul, src, size, n, total, target, least(upto - coalesce(lag(upto) OVER (PARTITION BY nul, src ORDER BY size DESC), 0), 2 * n)::BIGINT AS c FROM u),
{repairs}
d AS (SELECT w.*, c3.n, c3.c, c3.total, c3.target, row_number() OVER (PARTITION BY nul, src, size ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) AS place FROM w JOIN c3 USING (nul, src, size))
SELECT doc_id, size, total AS source_size, round(target, 6) AS target, ((c // n + (place <= c % n)::INT) * size)::BIGINT AS taken FROM d
""".replace("{repairs}", "\n".join(f"""m{k} AS (SELECT nul, src, max(target) - sum(c * size) AS missing FROM c{k} GROUP BY nul, src),
b{k} AS (SELECT nul, src, min(struct_pack(gap := abs(missing - way * size), size := size, way := way)) AS best FROM (SELECT nul, src, size, missing, CASE WHEN missing > 0 AND c < 2 * n THEN 1 WHEN missing < 0 AND c > 0 THEN -1 END AS way
    FROM c{k} JOIN m{k} USING (nul, src) WHERE size > 0) WHERE way IS NOT NULL AND abs(missing - way * size) < abs(missing) GROUP BY nul, src),
c{k + 1} AS (SELECT c.nul, c.src, c.size, n, total, target, c.c + coalesce(best.way, 0) AS c FROM c{k} c LEFT JOIN b{k} ON b{k}.nul = c.nul AND b{k}.src = c.src AND best.size = c.size),""" for k in range(3)))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")), "vec_id % 100 = 0")


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS own, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT a, b, score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER w)::INTEGER AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.own AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER w <= 10
"""


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS x FROM documents),
f AS (SELECT part, (len(x) < 100)::INT + 2 * (100 * len(list_distinct(x)) < 80 * len(x))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask,
             (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL))::INT AS good, (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))::INT AS bad FROM w),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, mask),
l(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT [p.b, q.b, r.b, s.b, u.b] AS bits, p.c || q.c || r.c || s.c || u.c AS filter_order FROM l p, l q, l r, l s, l u WHERE len(list_distinct([p.b, q.b, r.b, s.b, u.b])) = 5),
k AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS prior FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (own | prior) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & prior = 0), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (mask & own > 0 AND mask & prior > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (mask & own > 0 AND mask & prior = 0), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (mask & own > 0 AND mask & prior = 0), 0)::BIGINT AS toxic_lost FROM m, k GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""


QUERIES = {
    "op1_packing": op1_packing,
    "op2_media": op2_media,
    "op3_topk": op3_topk,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_minhash": op5_minhash,
    "op6_quality": op6_quality,
    "op7_pieces": op7_pieces,
    "op8_url_filter": op8_url_filter,
    "op9_licenses": op9_licenses,
    "op10_toxicity": op10_toxicity,
    "op11_mixing": op11_mixing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_filter_audit": op13_filter_audit,
}


class Texts(Mapping):
    """SQL by query; a text that has to be worked out first (a trained model's) is made when it is asked for."""

    def __init__(self, **texts: str | Callable[[], str]):
        self.texts = texts

    def __getitem__(self, name: str) -> str:
        text = self.texts[name]
        return text() if callable(text) else text

    def __iter__(self):
        return iter(self.texts)

    def __len__(self) -> int:
        return len(self.texts)


ORACLE_SQL = Texts(op3_topk=OP3_SQL, op5_minhash=OP5_SQL, op8_url_filter=OP8_SQL, op9_licenses=op9_sql, op11_mixing=OP11_SQL, op12_hard_negatives=OP12_SQL, op13_filter_audit=OP13_SQL)
