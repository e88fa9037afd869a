"""One query per operator: the operator over its whole table, and the digests of its output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quorum.llm import (
    bpe,
    chat,
    collocations,
    decontaminate,
    exact,
    html_text,
    idfiles,
    language,
    near,
    periodic,
    pii,
    quality,
    sharding,
)
from quorum.llm.common import doc_bucket, shared_path, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
QUALITY_THRESHOLD = 0.3
SHARDS = 16


def held_out(parts: int, part: int):
    """Whether the id's bucket is the one kept out of learning; a null id is not."""
    return F.coalesce(doc_bucket(F.col("doc_id"), parts) == part, F.lit(False))


def op1_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_exact_dedup(spark, sf_dir):
    rows = exact.classes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, ~held_out(4, 2) & F.col("doc_id").isNotNull())
    predicted = language.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op5_token_id_files(spark, sf_dir):
    path = shared_path(spark)
    docs = table(spark, sf_dir, "documents")
    idfiles.write_ids(docs, path, public_tokenizers.path(TOKENIZER), END_ID)
    rows = idfiles.read_ids(spark, path)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_bootstrapped_pii(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    others = [F.size(F.array_remove(kinds, kind)) for kind in pii.KINDS]
    counts = [(F.size("base") - n).cast("long").alias(f"n_{kind}") for n, kind in zip(others, pii.KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.spell(F.col("base")), 256).alias("base_sha256"),
        pii.spell(F.col("spans")).alias("spans"),
    )


def op7_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, ~held_out(5, 0) & F.col("doc_id").isNotNull())
    scored = quality.score(docs.select("doc_id", "text"), model)
    predicted = F.when(F.col("score") >= QUALITY_THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", predicted.alias("predicted"))


def op8_bpe_codec(spark, sf_dir):
    path = public_tokenizers.path(TOKENIZER)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    return coded.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_parity_sketch_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return near.components(docs, shingle=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op10_chat_format(spark, sf_dir):
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(chat.ASSISTANT).alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.examples(rows)
    loss = chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))
    # The last example of a conversation holds all its turns.
    last = F.max_by("formatted", "target")
    back = made.groupBy("conv_id").agg(
        chat.parse(last).alias("turns"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("target", loss.alias("text")))), lambda x: x["text"]), ""
        ).alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op11_periodic_runs(spark, sf_dir):
    """The contract repeats the end of one text in ten, by the id's crc32, before the search."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", hashed.alias("h"))
    docs = docs.withColumn("n", F.when(F.col("h") % 10 == 0, F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))))
    docs = docs.withColumn("a", F.expr("if(n > 0, (h div 10) % n, null)"))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    found = periodic.runs(docs.select("doc_id", "text", "a", "p"), tail=("a", "p"))
    best = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.col1")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(-1000 * best.col1) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_rendezvous_shards(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(sharding.key_text(F.col("doc_id")), F.lit("|"), text)).alias("digest"),
        sharding.shard_of(F.col("doc_id"), [1] * SHARDS).alias("shard"),
        sharding.shard_of(F.col("doc_id"), [1] * (SHARDS + 1)).alias("grown_shard"),
    )
    rows = sharding.slots(docs, "digest", SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_decontaminate": op2_decontaminate,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_token_id_files": op5_token_id_files,
    "op6_bootstrapped_pii": op6_bootstrapped_pii,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_parity_sketch_join": op9_parity_sketch_join,
    "op10_chat_format": op10_chat_format,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_rendezvous_shards": op12_rendezvous_shards,
    "op13_collocations": op13_collocations,
}

ORACLE: dict[str, str] = {
    "op2_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
              FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s(i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM g),
        c AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
              FROM d, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS s(i)),
        hits AS (SELECT doc_id, i, n, item_id FROM c JOIN g USING (n, gram)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits)
                  GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op10_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
                     sum(20 + length(role) + length(text)
                         + 2 * (length(role) + length(text)) - length(replace(role, '\', '')) - length(replace(text, '\', ''))
                         - length(replace(role, '<', '')) - length(replace(text, '<', ''))) OVER w AS so_far
              FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
                     coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss,
                     sum(so_far) FILTER (role = 'assistant' OR i = n) AS chars
              FROM n GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
               chars::BIGINT AS formatted_chars FROM g
    """,
    "op3_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s
                   FROM documents),
        g AS (SELECT s, min(doc_id) AS keep_id, count(*) AS n FROM t GROUP BY s)
        SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, t.s AS text_sha256
        FROM t JOIN g USING (s)
    """,
    "op12_rendezvous_shards": r"""
        WITH crc_table AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)),
                      lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
        b AS (SELECT *, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM d),
        c AS (SELECT doc_id, k, len(bytes) + 1 AS size, md5(k || '|' || text) AS digest,
                     xor(list_reduce(list_concat([4294967295], bytes),
                                     lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
              FROM b, crc_table),
        s AS (SELECT *, list_transform(range(17), lambda i: substring(md5(k || '|' || i::VARCHAR), 1, 13)) AS draws FROM c),
        r AS (SELECT *, list_position(draws[1:16], list_max(draws[1:16])) - 1 AS shard,
                     list_position(draws, list_max(draws)) - 1 AS grown FROM s)
        SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY digest) - 1 AS slot, grown::INTEGER AS grown_shard
        FROM r
    """,
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        g AS (SELECT lang, m, unnest(list_transform(range(1, greatest(len(w) - m + 2, 1)),
                     lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
              FROM w, (VALUES (1), (2), (3), (4)) AS sizes(m)),
        f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE m >= 2 AND f >= 30),
        inner_ AS (SELECT lang, f, unnest(list_transform(range(1, greatest(m - k + 2, 1)),
                          lambda i: array_to_string(string_split(phrase, ' ')[i : i + k - 1], ' '))) AS phrase
                   FROM c, (VALUES (2), (3)) AS sizes(k) WHERE k < m),
        longer AS (SELECT lang, phrase, max(f) AS most FROM inner_ GROUP BY ALL),
        kept AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE coalesce(100 * most < 80 * f, true)),
        cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS p1,
                        array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS p2
                 FROM kept, (VALUES (1), (2), (3)) AS s(k) WHERE k < m),
        scored AS (SELECT cuts.*, l.f AS l, r.f AS r, ((2000000 * a::HUGEINT) // (l.f + r.f))::BIGINT AS score
                   FROM cuts JOIN f AS l ON l.lang = cuts.lang AND l.phrase = p1
                   JOIN f AS r ON r.lang = cuts.lang AND r.phrase = p2),
        weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
    """,
}
