"""The registered queries of the training-data operators, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import (ann, bpe, exact_dedup, fim, hyperminhash, line_dedup, lm_score, ngram_join, packing, substring_dedup,
                          toxicity, url_filter, whitening)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's URL: rules, else a listing of the pages of ad hosts."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.select(url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    return url_filter.judge(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"),
                            listed.where(F.col("host").contains("ads-")))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginal log probability of each document under a subword lattice."""
    return lm_score.score_documents(table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("piece_bpe_32k.model"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them."""
    out = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that an earlier line makes redundant."""
    out = line_dedup.duplicate_lines(table(spark, sf_dir, "documents"))
    numbers = F.transform("removed", lambda i: i.cast("string"))
    return out.withColumn("removed", F.array_join(numbers, ","))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and number of links of each document."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each document's tokens in training sequences of four lengths."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of each document without passages of 50 words that an earlier one has."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents; the largest doc_id of each stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates on pairs of words, by HyperMinHash."""
    return hyperminhash.near_components(table(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of each document, digests of the output and of the text rebuilt from it."""
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restored("output", "form"), 256).alias("restored_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector on the eight leading components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_lm_score": op2_lm_score,
    "op3_bpe": op3_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_packing": op6_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_ann": op10_ann,
    "op11_minhash_dedup": op11_minhash_dedup,
    "op12_fim": op12_fim,
    "op13_whitening": op13_whitening,
}

# A-Z only: DuckDB's lower() would fold other letters too.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op1_url_filter": """
        WITH p AS (SELECT row_number() OVER () AS n, page_id,
                          coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                          coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
                   FROM pages),
             r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                   ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
             fit AS (SELECT n, max_by(h || r.p, length(h || r.p)) AS rule, max_by(v, length(h || r.p)) AS verdict
                     FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY n),
             listed AS (SELECT DISTINCT host, path FROM p WHERE contains(host, 'ads-'))
        SELECT p.page_id, p.host, p.path, fit.rule,
               coalesce(fit.verdict, CASE WHEN listed.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
        FROM p LEFT JOIN fit USING (n) LEFT JOIN listed ON p.host = listed.host AND p.path = listed.path""",
    "op4_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          unnest(range(len(string_split(coalesce(text, ''), chr(10)))))::INT AS line_no
                   FROM documents),
             n AS (SELECT doc_id, line_no, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l),
             f AS (SELECT norm, string_split(norm, ' ') AS w, min((doc_id, line_no)) AS place
                   FROM n WHERE norm <> '' GROUP BY norm),
             v AS (SELECT norm, place, len(w) AS n, i,
                          list_concat(list_slice(w, 1, i - 1), list_slice(w, i + 1, len(w))) AS rest
                   FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= 5)),
             k AS (SELECT norm, place, (n, i, rest) AS key, false AS plain, false AS shorter FROM v
                   UNION ALL SELECT norm, place, (n - 1, 0, rest), false, true FROM v
                   UNION ALL SELECT norm, place, (len(w), 0, w), true, false FROM f WHERE len(w) >= 5),
             near AS (SELECT DISTINCT norm FROM (SELECT norm, place, CASE WHEN shorter
                        THEN min(place) FILTER (plain) OVER (PARTITION BY key)
                        ELSE min(place) FILTER (NOT plain) OVER (PARTITION BY key) END AS low FROM k)
                      WHERE low < place),
             gone AS (SELECT n.doc_id, list_sort(list(n.line_no)) AS removed
                      FROM n JOIN f USING (norm) LEFT JOIN near USING (norm)
                      WHERE near.norm IS NOT NULL OR (n.doc_id, n.line_no) <> f.place GROUP BY n.doc_id)
        SELECT d.doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_lines,
               len(coalesce(removed, [])) AS n_removed, coalesce(array_to_string(removed, ','), '') AS removed
        FROM documents d LEFT JOIN gone USING (doc_id)""",
    "op7_substring_dedup": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')
                          AS words FROM documents),
             p AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS passage
                   FROM (SELECT *, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
             gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j
                      FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY passage) AS low FROM p)
                      WHERE low < doc_id),
             kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text
                      FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w)
                      ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
             n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
               sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op9_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op11_minhash_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '')
                          AS words FROM documents),
             s AS (SELECT DISTINCT doc_id, words[i] || ' ' || words[i + 1] AS shingle
                   FROM (SELECT *, unnest(range(1, len(words))) AS i FROM w WHERE len(words) >= 2)
                   UNION ALL SELECT doc_id, words[1] FROM w WHERE len(words) = 1),
             z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
                   FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
             l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b
                   WHERE 100 * common >= 80 * (x.n + y.n - common)),
             r AS (SELECT doc_id AS node, doc_id AS seen FROM documents
                   UNION SELECT l.a, r.seen FROM l JOIN r ON r.node = l.b),
             c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
        SELECT doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
        FROM documents LEFT JOIN z USING (doc_id) JOIN c ON c.node = doc_id""",
    "op12_fim": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
                          regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                          sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
             d AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a,
                          ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                                    OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                               WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
             c AS (SELECT doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') AS p,
                          array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
                          array_to_string(u[greatest(a, b) + 1:n], '') AS s FROM d)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
        FROM c""",
}
