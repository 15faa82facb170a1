"""The registered queries of this subpackage: operators over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudtally.llm import chat, decontam, jaccard, language, lexical, licenses, lines, mixing, repair, scoring, simhash, tokens, topk
from cloudtally.llm.shared import crc32_bucket, table
from cloudtally.session import scratch_dir

S = SparkSession

#: Target parts of the mix by source; all other sources share the rest. A block is this many characters.
MIX_WEIGHTS = {"src0": 20, "src1": 10, "src2": 10, "src3": 5}
MIX_REST = 55
MIX_BLOCK = 65_536


#: Token ids: the vocabulary's file and size, and the id behind each document.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
VOCABULARY = 49_408
END = 1


def op1_lines(spark: S, sf: str) -> DataFrame:
    """Every document without the lines that an earlier one repeats."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs)


def op2_mixing(spark: S, sf: str) -> DataFrame:
    """The place of every document in the mix, shares counted in characters."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.char_length("text").alias("size"))
    return mixing.mix_sources(docs, MIX_WEIGHTS, MIX_REST, MIX_BLOCK, "size")


def op3_topk(spark: S, sf: str) -> DataFrame:
    """The ten best other vectors of every hundredth vector."""
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op4_chat(spark: S, sf: str) -> DataFrame:
    """All conversations formatted, and what reads back from the formatted texts."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    messages = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.format_chats(messages.withColumn("parts", chat.text_parts(F.col("text"))))
    turns = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = made.select(
        "*", turns.alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "attachment_tokens",
    )


def op5_decontamination(spark: S, sf: str) -> DataFrame:
    """Benchmark items found in documents, one row per document and item."""
    return decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("text_hash")


def op6_scoring(spark: S, sf: str) -> DataFrame:
    """log10 probability of every document under a model of six sevenths of them."""
    scored = scoring.score_texts(table(spark, sf, "documents"), crc32_bucket("doc_id", 7) != 2)
    return scored.select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bytes", "bits_per_byte"
    )


def op7_language(spark: S, sf: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", language.held_out().alias("held_out"))
    model = language.train(docs.filter("NOT held_out"))
    return language.classify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_licenses(spark: S, sf: str) -> DataFrame:
    """License notices and terms found in documents."""
    return licenses.scan_licenses(table(spark, sf, "documents"))


def op9_tokens(spark: S, sf: str) -> DataFrame:
    """Token ids of every document, written in coded blocks and read back."""
    path = scratch_dir(spark, "token-ids")
    tokens.write_ids(table(spark, sf, "documents"), path, TOKENIZER, VOCABULARY, END)
    return tokens.read_ids(spark, path, with_ids=False).drop("ids")


def op10_simhash(spark: S, sf: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.simhash_groups(table(spark, sf, "documents"), shingle=4, radius=4)


def op11_jaccard(spark: S, sf: str) -> DataFrame:
    """Shingle set, group and number of links of every document, at a similarity of 0.8."""
    return jaccard.jaccard_groups(table(spark, sf, "documents"), shingle=5, percent=80)


def op12_repair(spark: S, sf: str) -> DataFrame:
    """What is wrong with every damaged conversation, and its cheapest repair."""
    said = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repaired_or_empty(said, repair.repair_conversations(repair.damage(said)))


def op13_lexical(spark: S, sf: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)


QUERIES = {
    f.__name__: f for f in (
        op1_lines, op2_mixing, op3_topk, op4_chat, op5_decontamination, op6_scoring, op7_language, op8_licenses, op9_tokens, op10_simhash,
        op11_jaccard, op12_repair, op13_lexical,
    )
}

_CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<image>", "<audio>", "<document>")


def _escaped_length(text: str) -> str:
    broken = " + ".join(f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in _CONTROLS)
    return f"2 * length({text}) - length(replace({text}, chr(92), '')) + {broken}"


ORACLE: dict[str, str] = {
    "op3_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ),
        s AS (
          SELECT q.vec_id AS query_id, d.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
          FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v)
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 10""",
    "op4_chat": f"""
        WITH m AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
          CAST(3 + sum(6 + {_escaped_length('role')} + 7 + {_escaped_length('text')} + 4) AS BIGINT) AS formatted_chars,
          CAST(0 AS BIGINT) AS attachment_tokens
        FROM m GROUP BY conv_id""",
    "op11_jaccard": """
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ),
        s AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
          SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
          JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
        ),
        reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
        gone AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
        sets AS (SELECT doc_id, hash(list(g ORDER BY g)) AS same FROM s GROUP BY doc_id),
        other AS (
          SELECT l.a AS doc_id, count(DISTINCT y.same) AS n_links FROM links l JOIN sets x ON x.doc_id = l.a JOIN sets y ON y.doc_id = l.b
          WHERE x.same <> y.same GROUP BY l.a
        )
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, g.component_id, CAST(coalesce(o.n_links, 0) AS BIGINT) AS n_links
        FROM documents d JOIN gone g ON g.a = d.doc_id LEFT JOIN n USING (doc_id) LEFT JOIN other o USING (doc_id)""",
    "op13_lexical": r"""
        WITH t AS (
          SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents
        ),
        q AS (
          SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark
        ),
        n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
        c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
        f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, docs),
        s AS (
          SELECT q.item_id, f.doc_id, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (100 - 90 + (90 * n.n * c.docs) // c.words)))) AS BIGINT) AS score
          FROM q JOIN f USING (term) JOIN w USING (term) JOIN n ON n.doc_id = f.doc_id, c GROUP BY q.item_id, f.doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 10""",
}
