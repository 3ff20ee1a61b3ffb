"""The operators as queries over the given tables, and the SQL some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folio.llm import (
    bitsliced_topk, byte_cnn, hard_negatives, odd_sketch, packing, passage_quality, recurrent_lm, sentencepiece_index, suffix_dedup, trie_dedup, turn_repair,
    url_rules, warc,
)


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_index.round_trip(_table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_topk(spark: SparkSession, folder: str) -> DataFrame:
    return bitsliced_topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return recurrent_lm.score_documents(_table(spark, folder, "documents"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_table(spark, folder, "documents"))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    return byte_cnn.identify(_table(spark, folder, "documents"))


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return odd_sketch.near_groups(_table(spark, folder, "documents"), shingle=4, percent=80)


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(_table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, folder, "pages"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return passage_quality.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return trie_dedup.exact_groups(_table(spark, folder, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations in which a row's key decides whether it is dropped, emptied, left unended, repeated or given to the user."""
    space = F.lit(" ")
    turns = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    turns = turns.withColumn("_fault", F.crc32(key) % 20).filter("_fault <> 0")
    fault = F.col("_fault")
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1)))
    return turns.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = _table(spark, folder, "conversations")
    found = turn_repair.audits(damaged(conversations)).withColumnRenamed("conv_id", "_conv")
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.when(F.col("cost").isNull(), 0).otherwise(F.col(c)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit(""), 256)
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


# The rules that the query judges by.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op12_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(_table(spark, folder, "pages"), rules)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, label=moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_topk, op3_lm_score, op4_suffix_dedup, op5_language, op6_near_dedup, op7_packing, op8_warc, op9_quality, op10_exact_dedup,
        op11_turn_repair, op12_url_rules, op13_hard_negatives,
    )
}

ORACLES = {
    "op2_topk": """
        with v as (
            select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] q from embeddings
            where vec_id is not null and embedding is not null
              and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
        ), scored as (
            select a.vec_id query_id, b.vec_id,
                   cast(list_sum([p[1] * p[2] for p in list_zip(a.q, b.q)]) as bigint) score
            from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0
        ), ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank from scored)
        select query_id, rank, vec_id, score from ranked where rank <= 20""",
    "op8_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
        f as (select *, min(page_id) over (partition by payload_digest) first from p)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 100 and page_id > first then 'revisit' else 'response' end record_type,
               case when payload_bytes >= 100 and page_id > first then first end refers_to
        from f""",
    "op10_exact_dedup": r"""
        with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) text_sha256 from documents)
        select doc_id, min(doc_id) over w keep_id, count(*) over w group_size, doc_id = min(doc_id) over w kept, text_sha256
        from d window w as (partition by text_sha256)""",
    # damage, faults and then, from a conversation's last row to its first, the least (cost, audit) from each of the four states
    "op11_turn_repair": r"""
        with recursive k as (
            select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') txt,
                   coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key_text
            from conversations
        ), f as (
            select *, xor(list_reduce(
                       list_prepend(cast(4294967295 as bigint), flatten([[cast(unicode(key_text[i]) as bigint), 0, 0, 0, 0, 0, 0, 0] for i in range(1, length(key_text) + 1)])),
                       lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) % 20 fault
            from k
        ), d as (
            select conv_id, turn, case when fault = 4 then 'user' else role end role,
                   case fault when 1 then '' when 2 then translate(txt, '.!?', '') else txt end txt,
                   unnest(range(case when fault = 3 then 2 else 1 end)) copy_no
            from f where fault <> 0
        ), o as (
            select *, row_number() over (partition by conv_id order by turn nulls first, role, txt, copy_no) i from d
        ), g as (
            select *, left(role, 1) ini, not regexp_matches(txt, '[^\x20\x09-\x0D]') blank,
                   row_number() over (partition by conv_id, role, txt order by i) > 1 again,
                   not regexp_matches(txt, '[.!?][\x20\x09-\x0D]*\z') cut,
                   lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair
            from o
        ), h as (select *, blank or again gone, cast(not (blank or again) and cut as integer) t from g),
        e as (
            select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count_if(blank) blank,
                   count_if(not blank and again) duplicate, sum(t) truncated, count_if(pair not in ('su', 'ua', 'au')) illegal
            from h group by conv_id
        ), r as (
            select conv_id, n at_row, {'c': 0, 'a': '', 'b': cast([] as varchar[])} s0, {'c': 4, 'a': 'II', 'b': ['user:', 'assistant:']} s1,
                   {'c': 2, 'a': 'I', 'b': ['assistant:']} s2, {'c': 0, 'a': '', 'b': cast([] as varchar[])} s3
            from e
            union all
            select conv_id, at_row - 1,
                   list_sort([p0, {'c': 2 + q2.c, 'a': 'I' || q2.a, 'b': list_prepend('user:', q2.b)}])[1],
                   list_sort([p1, {'c': 2 + q2.c, 'a': 'I' || q2.a, 'b': list_prepend('user:', q2.b)}])[1], q2, q3
            from (
                select conv_id, at_row, p0, p1, list_sort([p2, {'c': 2 + p3.c, 'a': 'I' || p3.a, 'b': list_prepend('assistant:', p3.b)}])[1] q2,
                       list_sort([p3, {'c': 2 + p2.c, 'a': 'I' || p2.a, 'b': list_prepend('user:', p2.b)}])[1] q3
                from (
                    select r.conv_id, r.at_row,
                           list_sort([{'c': 3 + s0.c, 'a': 'D' || s0.a, 'b': s0.b},
                               {'c': t + s1.c + case when ini = 's' and not gone then 0 else 999999 end, 'a': 'K' || s1.a, 'b': list_prepend(role || ':' || txt, s1.b)},
                               {'c': t + s2.c + case when ini = 'u' and not gone then 0 else 999999 end, 'a': 'K' || s2.a, 'b': list_prepend(role || ':' || txt, s2.b)},
                               {'c': 2 + t + s2.c + case when gone then 999999 else 0 end, 'a': 'R' || s2.a, 'b': list_prepend('user:' || txt, s2.b)}])[1] p0,
                           list_sort([{'c': 3 + s1.c, 'a': 'D' || s1.a, 'b': s1.b},
                               {'c': t + s2.c + case when ini = 'u' and not gone then 0 else 999999 end, 'a': 'K' || s2.a, 'b': list_prepend(role || ':' || txt, s2.b)},
                               {'c': 2 + t + s2.c + case when gone then 999999 else 0 end, 'a': 'R' || s2.a, 'b': list_prepend('user:' || txt, s2.b)}])[1] p1,
                           list_sort([{'c': 3 + s2.c, 'a': 'D' || s2.a, 'b': s2.b},
                               {'c': t + s3.c + case when ini = 'a' and not gone then 0 else 999999 end, 'a': 'K' || s3.a, 'b': list_prepend(role || ':' || txt, s3.b)},
                               {'c': 2 + t + s3.c + case when gone then 999999 else 0 end, 'a': 'R' || s3.a, 'b': list_prepend('assistant:' || txt, s3.b)}])[1] p2,
                           list_sort([{'c': 3 + s3.c, 'a': 'D' || s3.a, 'b': s3.b},
                               {'c': t + s2.c + case when ini = 'u' and not gone then 0 else 999999 end, 'a': 'K' || s2.a, 'b': list_prepend(role || ':' || txt, s2.b)},
                               {'c': 2 + t + s2.c + case when gone then 999999 else 0 end, 'a': 'R' || s2.a, 'b': list_prepend('user:' || txt, s2.b)}])[1] p3
                    from r join h on h.conv_id is not distinct from r.conv_id and h.i = r.at_row
                )
            )
        )
        select c.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, cast(coalesce(truncated, 0) as bigint) truncated,
               coalesce(illegal, 0) illegal, cast(coalesce(s0.c, 0) as bigint) as cost, coalesce(s0.a, '') audit, sha256(coalesce(array_to_string(s0.b, chr(10)), '')) repaired_sha256
        from (select distinct conv_id from conversations) c
        left join e on e.conv_id is not distinct from c.conv_id
        left join r on r.conv_id is not distinct from c.conv_id and r.at_row = 0""",
    "op12_url_rules": f"""
        with r(host, path, verdict) as (values {", ".join(map(str, URL_RULES))}),
        u as (select page_id, row_number() over () row_no, case when instr(url, '://') > 0 then url[instr(url, '://') + 3 :] else '' end rest from pages),
        p as (
            select page_id, row_no, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
                   regexp_extract(rest[length(regexp_extract(rest, '^[^/?#]*')) + 1 :], '^[^?#]*') path
            from u
        ), m as (
            select p.*, r.host || r.path rule, r.verdict,
                   row_number() over (partition by row_no order by length(r.host || r.path) desc nulls last, length(r.host) desc) n
            from p left join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
        )
        select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from m where n = 1""",
    "op13_hard_negatives": """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label,
                   [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] q
            from embeddings
            where vec_id is not null and label is not null and embedding is not null
              and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
        ), s as (
            select a.vec_id anchor_id, b.vec_id, a.label = b.label same, cast(list_sum([x[1] * x[2] for x in list_zip(a.q, b.q)]) as bigint) score
            from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
        ), p as (
            select anchor_id, vec_id positive_id, score positive_score from s where same
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
        )
        select p.anchor_id, positive_id, cast(row_number() over w as integer) rank, s.vec_id negative_id, positive_score, s.score negative_score
        from p join s on s.anchor_id = p.anchor_id and not same and 100 * s.score between 50 * positive_score and 95 * positive_score
        window w as (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id)
        qualify rank <= 3""",
}
