"""The registered queries of the training-data operators, and the SQL that can state them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import bwt, chat, debruijn, exact, forest, pieces, ppm, setm, simhash, spelling, surrogates, winnow, wrappers

# The key of the replacements: a secret in production, so it comes from outside.
KEY = os.environ.get("LARDER_PII_KEY", "an example key").encode()
MODEL = os.environ.get("LARDER_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = winnow.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_ppm_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = ppm.identify(docs, ppm.fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", ppm.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.extracted(table(spark, folder, "pages"))


def op5_bwt(spark: SparkSession, folder: str) -> DataFrame:
    return bwt.deduplicated(table(spark, folder, "documents"), texts=False).drop("row_key")


def op6_debruijn(spark: SparkSession, folder: str) -> DataFrame:
    return debruijn.deduplicated(table(spark, folder, "documents"), texts=False).drop("row_key")


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(table(spark, folder, "documents"), pieces.load(MODEL)).drop("row_key")


def op8_forest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.nearest(table(spark, folder, "embeddings"))


def op9_role_repair(spark: SparkSession, folder: str) -> DataFrame:
    return chat.repaired(table(spark, folder, "conversations"))


def op10_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.anonymized(docs, KEY)


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, folder, "documents")))


def op12_exact(spark: SparkSession, folder: str) -> DataFrame:
    found = exact.groups(table(spark, folder, "documents"), every=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_setm(spark: SparkSession, folder: str) -> DataFrame:
    return setm.collocations(table(spark, folder, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_winnowing": op2_winnowing,
    "op3_ppm_language": op3_ppm_language,
    "op4_wrappers": op4_wrappers,
    "op5_bwt": op5_bwt,
    "op6_debruijn": op6_debruijn,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_forest": op8_forest,
    "op9_role_repair": op9_role_repair,
    "op10_surrogates": op10_surrogates,
    "op11_spelling": op11_spelling,
    "op12_exact": op12_exact,
    "op13_setm": op13_setm,
}
ORACLE: dict[str, str] = {
    "op2_winnowing": r"""
        WITH texts AS (
            SELECT 0 AS item, doc_id, '' AS item_id, text FROM documents UNION ALL SELECT 1, 0, item_id::VARCHAR, text FROM benchmark),
        words AS (
            SELECT item, doc_id, item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts),
        marks AS (
            SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS mark
            FROM (SELECT *, least(len(w), 10) AS size FROM words WHERE item = 1 AND len(w) > 0)),
        places AS (
            SELECT doc_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: {'i': i, 'mark': array_to_string(w[i : i + size - 1], ' ')})) AS p
            FROM words, (SELECT DISTINCT size FROM marks) WHERE item = 0),
        met AS (SELECT doc_id, places.p.i AS i, places.size, item_id FROM places JOIN marks ON marks.size = places.size AND marks.mark = places.p.mark),
        hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS spot FROM met) GROUP BY 1),
        named AS (SELECT doc_id, list(DISTINCT item_id ORDER BY item_id) AS items FROM met GROUP BY 1)
        SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
               sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words w LEFT JOIN hit ON hit.doc_id = w.doc_id LEFT JOIN named ON named.doc_id = w.doc_id WHERE item = 0""",
    "op6_debruijn": r"""
        WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        runs AS (
            SELECT doc_id, p.i, p.mark FROM (
                SELECT doc_id, unnest(list_transform(range(1, len(w) - 48), lambda i: {'i': i, 'mark': md5(array_to_string(w[i : i + 49], ' '))})) AS p FROM words)),
        late AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY mark) AS one FROM runs) WHERE doc_id > one),
        gone AS (SELECT doc_id, list(DISTINCT spot) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS spot FROM late) GROUP BY 1)
        SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: w[i]), ' ')) AS kept_sha256
        FROM words w LEFT JOIN gone ON gone.doc_id = w.doc_id""",
    "op11_spelling": r"""
        WITH RECURSIVE steps AS (
            SELECT list(list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
            FROM (SELECT unnest(range(256)) AS i)),
        found AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
            FROM documents),
        runs AS (SELECT run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM found GROUP BY doc_id, run),
        checked AS (
            SELECT run, n, xor(list_reduce(list_transform(range(1, len(code), 2), lambda i: ('0x' || code[i:i + 1])::BIGINT),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
            FROM runs, steps),
        slipped AS (
            SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM checked),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        cut AS (
            SELECT word, n, i, left(word, i) || substr(word, i + 2) AS less
            FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
        near AS (
            SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
            UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.less
            UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.less),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
        forms AS (
            SELECT w.word, CASE WHEN m >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n
            FROM words w LEFT JOIN best USING (word)),
        walk AS (
            SELECT word, word AS root FROM forms
            UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL)
        SELECT forms.word, form, ends.root, n, n_near, form_n
        FROM forms JOIN (SELECT walk.word, walk.root FROM walk JOIN forms ON forms.word = walk.root AND forms.form IS NULL) ends USING (word)""",
    "op12_exact": r"""
        WITH bare AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
        FROM bare WINDOW best AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST)""",
    "op13_setm": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
        runs AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
            FROM words, (SELECT unnest(range(1, 6)) AS k)),
        often AS (SELECT lang, phrase, k, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
        free AS (
            SELECT * FROM often s WHERE k > 1 AND NOT EXISTS (
                SELECT 1 FROM often t WHERE t.lang = s.lang AND t.k > s.k AND 100 * t.f >= 100 * s.f
                    AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' '))),
        cuts AS (
            SELECT lang, phrase, f, cut, array_to_string(string_split(phrase, ' ')[:cut], ' ') AS head,
                   array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS tail
            FROM free, (SELECT unnest(range(1, 5)) AS cut) WHERE cut < k),
        scored AS (
            SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, n, cut,
                   (1000::HUGEINT * c.f * n // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = c.head
            JOIN often y ON y.lang = c.lang AND y.phrase = c.tail JOIN totals t ON t.lang = c.lang),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM lowest QUALIFY rank <= 2000""",
}
