"""One query per operator of this folder, over the whole of its table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skirmish.llm import (
    byte_pairs, classifier, edit_counts, forced_cuts, hash_forest, html_text, importance, jaccard_join, packing, pii, rules, token_files, zone_clusters,
)
from skirmish.llm.common import read
from skirmish.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
                        pii.scores(F.col("spans")).alias("scores"))


def op2_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = byte_pairs.decode_documents(byte_pairs.encode_documents(read(spark, sf_dir, "documents")))
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(packing.token_counts(read(spark, sf_dir, "documents")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    shards = token_files.write_token_files(read(spark, sf_dir, "documents"), folder)
    stored = token_files.read_token_files(shards, folder)
    return stored.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_links", "n_text_links")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.assess(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return edit_counts.count_with_edits(docs.withColumn("edits", edit_counts.masked_numbers()))


def op10_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_zone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_clusters.cluster(read(spark, sf_dir, "embeddings"))


def op13_forced_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = forced_cuts.decode_documents(forced_cuts.encode_documents(read(spark, sf_dir, "documents")))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_pii, op2_hash_forest, op3_byte_bpe, op4_best_fit, op5_token_files, op6_html_text, op7_jaccard_join, op8_quality_rules, op9_edit_counts, op10_neighbour_vote,
    op11_importance, op12_zone_clusters, op13_forced_cuts)}

_DISTANCE = "list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
#: One round: each vector to its nearest centroid, each centroid to the floor of its mean.
_ROUND = """
        near{after} as (select row, any_value(v) v, arg_min(c, d * 16 + c) c from (select row, v, c, {distance} d from v, m{before}) group by row),
        parts{after} as (select c, i, sum(v[i])::bigint s, count(*) n from near{after}, (select unnest(range(1, 65)) i) group by c, i),
        m{after} as (select c, coalesce(x.m, m{before}.m) m from m{before}
                     left join (select c, list((s - ((s % n) + n) % n) // n order by i) m from parts{after} group by c) x using (c))""".replace("{distance}", _DISTANCE)

#: The rules, the join, the draw and the clusters, said again in SQL over the same tables.
SQL: dict[str, str] = {
    "op8_quality_rules": r"""
        with d as (select doc_id, source, coalesce(text, '') t from documents),
        w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
                list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
        win as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] x from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w)),
        rep as (select doc_id, i, count(*) over (partition by doc_id, x) n from win),
        cov as (select doc_id, count(distinct i + k) n from rep, (select unnest([0, 1, 2]) k) where n > 1 group by doc_id),
        m as (select w.doc_id, source, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, len(ls) n_lines,
                coalesce(cov.n, 0)::bigint n_repeat_words from w left join cov using (doc_id)),
        f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
                (n_symbols > 0.1 * n_words)::int + (n_dup_lines > 0.3 * n_lines)::int + (not word_chars / greatest(n_words, 1) between 2.0 and 20.0)::int minor from m),
        h as (select source, count(*) n, count(*) filter (base_failed or minor > 0) failed from f group by source),
        s as (select sum(n)::double sn, sum(failed)::double / sum(n) mean, count(*) k, sum(n * n)::double sn2, sum(failed * failed / n::double) sq from h),
        v as (select *, (sq - sn * mean * mean - (k - 1) * mean * (1 - mean)) / nullif(sn - sn2 / sn, 0) spread from s),
        p as (select mean, case when spread > 0 then greatest(1.0, mean * (1 - mean) / spread - 1) else sn end strength from v),
        r as (select source, (failed + mean * strength) / (n + strength) rate from h, p)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          not base_failed and minor <= case when rate >= 0.5 then 0 else 1 end kept, round(rate, 6) host_rate
        from f join r on f.source is not distinct from r.source""",
    "op7_jaccard_join": r"""
        with recursive w as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
        sh as (select doc_id, case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                 when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end s from w),
        k as (select doc_id, len(s) n, case when len(s) > 0 then md5(array_to_string(list_sort(s), chr(10))) end set_id, s from sh),
        reps as (select set_id, min(doc_id) copy_id, count(*) copies, any_value(n) n, any_value(s) s from k where n > 0 group by set_id),
        e as (select copy_id, n, unnest(s) x from reps),
        pairs as (select a.copy_id a, b.copy_id b from e a join e b on a.x = b.x and a.copy_id < b.copy_id
                  group by a.copy_id, b.copy_id, a.n, b.n having count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
        both_ways as (select a, b from pairs union all select b, a from pairs),
        reach(a, b) as (select copy_id, copy_id from reps union select r.a, p.b from reach r join both_ways p on r.b = p.a),
        cls as (select a copy_id, min(b) class_id from reach group by a),
        lk as (select p.a copy_id, sum(copies) docs, count(*) texts from both_ways p join reps r on r.copy_id = p.b group by p.a)
        select k.doc_id, coalesce(c.class_id, k.doc_id) class_id, coalesce(r.copy_id, k.doc_id) copy_id,
          coalesce(r.copies - 1 + coalesce(lk.docs, 0), 0)::bigint n_links, coalesce(lk.texts, 0)::bigint n_text_links
        from k left join reps r using (set_id) left join cls c on c.copy_id = r.copy_id left join lk on lk.copy_id = r.copy_id""",
    "op11_importance": r"""
        with crc_table as (select list(list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b) order by b) t
                           from (select unnest(range(256)) b)),
        w as (select doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws from documents),
        q as (select list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws from benchmark),
        terms as (select distinct x from (select unnest(ws) x from w union all select unnest(ws) from q)),
        signs as (select x, list_transform(range(1, length(hex(x)), 2), lambda i: 16 * (instr('0123456789ABCDEF', substr(hex(x), i, 1)) - 1)
                    + instr('0123456789ABCDEF', substr(hex(x), i + 1, 1)) - 1) bs from terms),
        hashed as (select x, xor(list_reduce(bs, lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 10000 bucket from signs, crc_table),
        s as (select bucket, count(*) n from (select unnest(ws) x from w) join hashed using (x) group by bucket),
        t as (select bucket, count(*) n from (select unnest(ws) x from q) join hashed using (x) group by bucket),
        gains as (select h.x, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double
                    / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double)))::bigint g
                  from hashed h left join s using (bucket) left join t using (bucket)),
        docs as (select row_number() over () row, doc_id, ws from w),
        sums as (select row, sum(g)::bigint g from (select row, unnest(ws) x from docs) join gains using (x) group by row),
        scored as (select doc_id, len(ws)::bigint n_features, coalesce(g, 0) weight, row,
                     coalesce(g, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint score
                   from docs left join sums using (row)),
        placed as (select row, row_number() over (order by score desc, doc_id) rank, count(*) over () n from scored where n_features >= 20)
        select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end rank from scored left join placed using (row)""",
    "op12_zone_clusters": f"""
        with v as (select row_number() over () row, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) v from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        m0 as (select row_number() over (order by sha256('1:' || vec_id)) - 1 c, v m from v qualify c < 16),
        {",".join(_ROUND.format(before=i, after=i + 1) for i in range(3))},
        last as (select row, vec_id, {_DISTANCE} distance, c, m from v, m3),
        b as (select * from last qualify row_number() over (partition by row order by distance, c) = 1)
        select vec_id, c::int "cluster", distance, (sum(distance) over (partition by c))::bigint cluster_inertia, (sum(distance) over ())::bigint inertia,
          sha256(array_to_string(m, ',')) centroid_sha256 from b""",
}
