"""The queries of this package, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provrank.llm import conversation_repair, decontam, embedding_dedup, filter_audit, html_text, lang_id, line_dedup, omh_dedup, quality, secret_scan, sp_codec, token_count, url_filter
from provrank.llm._common import table

BLOCK = ("net/", "example.com/de/")
ALLOW = ("example.net/en/", "org/fr/")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def sp_model() -> str:
    return tokenizer("piece_bpe_32k.model")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = url_filter.RuleTrie(block=BLOCK, allow=ALLOW)
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), trie).select("page_id", "host", "path", "rule", "verdict")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_lines(docs).select("doc_id", "source", "n_lines", "n_dropped", "text")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = omh_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = lang_id.fold(F.col("doc_id"), 3)
    model = lang_id.fit(docs.where(fold != 1))
    out = lang_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    fold = lang_id.fold(F.col("doc_id"), 5)
    model = quality.fit(docs, labels.where(fold != 0))
    out = docs.select("doc_id", (fold == 0).alias("held_out"), quality.score(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count("random").alias("n_random"), "n_confirmed")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sp_codec.encode_decode(docs, sp_model())
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, tokenizer("word_bpe_49k.json"), limit=2048).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    every = (
        op1_url_filter, op2_embedding_dedup, op3_line_dedup, op4_order_minhash, op5_language_id,
        op6_decontamination, op7_quality, op8_secret_scan, op9_html_text, op10_sentencepiece,
        op11_token_count, op12_conversation_repair, op13_filter_audit,
    )
    return {f.__name__: f for f in every}


_HOST = r"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '')"


def _repair_sql() -> str:
    """The dynamic program row by row: a layer lists the cheapest (cost, audit, repaired text) for nothing yet, after system, after user, after assistant."""
    add = lambda t, line: f"{t} || CASE WHEN {t} = '' THEN '' ELSE chr(10) END || {line}"
    edit = lambda x, cost, letter, t: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {t}}}"
    put = lambda x, role: edit(x, 3, "I", add(f"{x}.t", f"'{role}:'"))
    least = lambda *xs: f"list_sort([{', '.join(xs)}])[1]"
    none = "{'c': 1000000000, 'a': '', 't': ''}"
    gone = lambda x: edit(x, 4, "D", f"{x}.t")
    keep = lambda x, kind: f"CASE WHEN r.fault < 2 AND r.kind = '{kind}' THEN {edit(x, '3 * r.fault', 'K', add(f'{x}.t', 'r.role || chr(58) || r.text'))} ELSE {none} END"
    name = lambda x, role: f"CASE WHEN r.fault < 2 THEN {edit(x, '3 + 3 * r.fault', 'R', add(f'{x}.t', f'{chr(39)}{role}:{chr(39)} || r.text'))} ELSE {none} END"
    # inserts before a row: first a user row, then an assistant row, which can also follow a user row just inserted
    user = least("l[3]", put("l[1]", "user"), put("l[2]", "user"), put("l[4]", "user"))
    opened = f"list_transform([list_transform([l], lambda l: [l[1], l[2], {user}, l[4]])[1]], lambda m: [m[1], m[2], m[3], {least('m[4]', put('m[3]', 'assistant'))}])[1]"
    after = (
        f"[{gone('o[1]')}, {least(gone('o[2]'), keep('o[1]', 's'))}, "
        f"{least(gone('o[3]'), *[f(x, w) for x in ('o[1]', 'o[2]', 'o[4]') for f, w in ((keep, 'u'), (name, 'user'))])}, "
        f"{least(gone('o[4]'), keep('o[3]', 'a'), name('o[3]', 'assistant'))}]"
    )
    step = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
    table = "range(256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda x: {step})"
    return f"""
        WITH RECURSIVE k AS (SELECT {table} AS crc),
        d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT),
                         lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS damage
              FROM conversations, k),
        f AS (SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role, copy,
                     CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
              FROM d, range(0, 2) c(copy) WHERE damage <> 0 AND (copy = 0 OR damage = 3)),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text[:64], sha256(text), copy) AS i FROM f),
        e AS (SELECT *, substr(role, 1, 1) AS kind, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
                     row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
        r AS MATERIALIZED (SELECT *, CASE WHEN last = '' THEN 2 WHEN again THEN 3 WHEN last NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault FROM e),
        p AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, [{{'c': 0, 'a': '', 't': ''}}, {none}, {none}, {none}] AS l FROM conversations
              UNION ALL SELECT r.conv_id, r.i, list_transform([{opened}], lambda o: {after})[1] FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1),
        z AS (SELECT conv_id, {least('o[1]', 'o[4]')} AS best FROM (SELECT conv_id, {opened} AS o FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((fault = 2)::INT) AS blank, sum((fault = 3)::INT) AS duplicate,
                     sum((fault = 1)::INT) AS truncated, sum((before IS NOT NULL AND before || kind NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM r GROUP BY conv_id)
        SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(best.t) AS repaired_sha256
        FROM z LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": f"""
            WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
            m AS (SELECT *, CASE
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM u)
            SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM m""",
        "op3_line_dedup": """
            WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
            l AS (SELECT k, source, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS i FROM d),
            n AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
            bad AS (SELECT l.source, line FROM l JOIN n ON l.source IS NOT DISTINCT FROM n.source
                    WHERE trim(line, ' ') <> '' GROUP BY l.source, line, pages
                    HAVING count(DISTINCT k) >= 3 AND count(DISTINCT k) > 0.1 * pages),
            kept AS (SELECT k, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY i) AS text
                     FROM l WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM l.source AND bad.line = l.line) GROUP BY k)
            SELECT d.doc_id, d.source, coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce(len(parts) - coalesce(n_kept, 0), 0)::BIGINT AS n_dropped,
                   CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
            FROM d LEFT JOIN kept USING (k)""",
            "op12_conversation_repair": _repair_sql(),
        "op13_filter_audit": r"""
            WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
            w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
            m AS (SELECT doc_id, part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
                         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
                         + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask FROM w),
            g AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
            c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN g USING (doc_id) GROUP BY ALL),
            f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
            o(filter_order, used) AS (SELECT '', 0 UNION ALL SELECT filter_order || letter, used + bit FROM o, f WHERE used & bit = 0),
            s AS (SELECT filter_order, step, bit, (SELECT coalesce(sum(b.bit), 0) FROM f b WHERE strpos(filter_order, b.letter) < step) AS before
                  FROM o, range(1, 6) r(step), f WHERE used = 31 AND letter = filter_order[step]),
            q AS (SELECT part, filter_order, step, bit,
                    sum(CASE WHEN mask & (before::INT | bit) = 0 THEN n ELSE 0 END) AS kept,
                    sum(CASE WHEN mask & before::INT = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
                    sum(CASE WHEN mask & before::INT <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
                    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                    sum(CASE WHEN mask & before::INT = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
                    sum(CASE WHEN mask & before::INT = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
                  FROM c, s GROUP BY ALL)
            SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
                   good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM q""",
    }
