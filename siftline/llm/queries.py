"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import PLAIN_READS


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.options(**PLAIN_READS).parquet(f"{sf_dir}/{name}.parquet")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op3_flat_graph_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dup import near_duplicate_vectors

    found = near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), limit=0.93)
    # whether the search of the vector's shard reached the recall that it is audited for
    return found.withColumn("audit_recall", F.coalesce(F.col("audit_recall") >= 0.995, F.lit(True))).withColumnRenamed("audit_recall", "audit_passed")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .leakage import decontaminate

    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10, slop=2)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def op7_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack, token_pieces

    pieces = token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_len=2048, end_id=0, by_word=True)
    return pack(pieces, max_len=2048)


def op8_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    found = find_personal_data(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_spans"))


def op10_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_store import round_trip

    return round_trip(_table(spark, sf_dir, "pages"), min_bytes=0)


#: The contract's rules for op1.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op1_url_trust_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_trust import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import stupid_backoff

    scored = stupid_backoff(_table(spark, sf_dir, "documents"), order=3)
    return scored.select("doc_id", "n_words", "n_alone", F.round("mean_log_score", 6).alias("mean_log_score"))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .grade_model import fit_grades, graded, score_grades

    documents = _table(spark, sf_dir, "documents")
    ratings = graded(_table(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic"))
    return score_grades(documents, fit_grades(documents, ratings))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_trust_propagation,
        op2_minhash_near_dedup,
        op3_flat_graph_near_dedup,
        op4_benchmark_decontamination,
        op5_stupid_backoff,
        op6_ordinal_quality,
        op7_best_two_fit_packing,
        op8_boosted_pii,
        op9_license_scan,
        op10_chunked_warc,
    )
}
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(source: str, key: str, pattern: str, text: str = "text") -> str:
    return f"select {key}, coalesce(regexp_extract_all(translate({text}, '{_UP}', '{_LOW}'), '{pattern}'), []) as ws from {source}"


_SPACED, _PLAIN = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: From links(a, b), in both directions, and nodes(id): the smallest id that each reaches.
_REACH = "reach as (select id as a, id as b from nodes union select r.a, l.b from reach r join links l on l.a = r.b), roots as (select a as id, min(b) as root from reach group by a)"


def _url_trust_sql(rounds: int = 12, damping: float = 0.85, margin: float = 0.01) -> str:
    host = f"coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{_UP}', '{_LOW}'), '')"
    path = "coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
    when = "".join(
        f" when (host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}') then '{r}'" for r in sorted(URL_RULES, key=lambda r: (-len(r), r))
    )
    verdict = "".join(f" when rule = '{r}' then '{v}'" for r, v in URL_RULES.items())
    link = """'(?i)href\\s*=\\s*["'']?(?:https?:)?//([^/?#"''\\s<>]+)'"""
    out = f"""with p as (select page_id, {host} as host, {path} as path, html from pages), r as (select *, case{when} end as rule from p), v as (select *, case{verdict} end as by_rule from r),
 per as (select host, avg(case when by_rule = 'allow' then 1.0 else 0 end) as allowed, avg(case when by_rule = 'block' then 1.0 else 0 end) as blocked from v where host <> '' group by host),
 seeds as (select host, case when blocked >= 0.5 then 'distrust' else 'trust' end as kind, {1 - damping}::double as score from per where blocked >= 0.5 or allowed >= 0.5),
 links as (select host as src, translate(unnest(regexp_extract_all(html, {link}, 1)), '{_UP}', '{_LOW}') as dst from p),
 edges as (select src, dst, count(*)::double as weight from links where src <> dst and src <> '' and dst <> '' group by all),
 both_ways as (select src, dst, weight, 'trust' as kind from edges union all select dst, src, weight, 'distrust' from edges),
 flow as (select src, dst, kind, {damping} * weight / sum(weight) over (partition by src, kind) as share from both_ways),
 s0 as (select host, kind, score from seeds)"""
    for i in range(rounds):
        out += f",\n s{i + 1} as (select host, kind, sum(score) as score from (select dst as host, f.kind, share * score as score from flow f join s{i} s on s.host = f.src and s.kind = f.kind union all select * from seeds) group by host, kind)"
    return (
        out
        + f""",
 scores as (select host, coalesce(sum(score) filter (kind = 'trust'), 0) as trust, coalesce(sum(score) filter (kind = 'distrust'), 0) as distrust from s{rounds} group by host)
 select page_id, v.host as host, path, rule, coalesce(by_rule, case when coalesce(distrust, 0) - coalesce(trust, 0) > {margin} then 'block' else 'allow' end) as verdict from v left join scores on scores.host = v.host"""
    )


def _license_sql(share: float = 0.8) -> str:
    from .license_scan import SHINGLE, TEMPLATES, template_words, window_size

    rows = ", ".join(f"('{k}', {window_size(len(template_words(v)))}, {template_words(v)!r})" for k, v in TEMPLATES.items())
    grams = f"list_distinct(case when len(ws) >= {SHINGLE} then list_transform(generate_series(1, len(ws) - {SHINGLE - 1}), lambda i: array_to_string(ws[i:i+{SHINGLE - 1}], ' ')) else [array_to_string(ws, ' ')] end)"
    return f"""with t as (select template, wide, greatest(1, wide // 4) as step, {grams} as wanted from (values {rows}) as x(template, wide, ws)),
 tg as (select template, wide, step, len(wanted) as n, unnest(wanted) as g from t),
 d as (select doc_id, regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[a-z0-9]+') as ws from documents),
 dg as (select doc_id, unnest(generate_series(0, len(ws) - {SHINGLE})) as p, unnest(list_transform(generate_series(1, len(ws) - {SHINGLE - 1}), lambda i: array_to_string(ws[i:i+{SHINGLE - 1}], ' '))) as g from d where len(ws) >= {SHINGLE}),
 hit as (select doc_id, template, wide, step, n, p, g from dg join tg using (g)),
 win as (select doc_id, template, n, g, unnest(generate_series(greatest(0, (p + {SHINGLE} - wide + step - 1) // step), p // step)) * step as first_word from hit where p + {SHINGLE} <= wide or p // step * step + wide >= p + {SHINGLE}),
 got as (select doc_id, template, first_word, count(distinct g) / any_value(n) as containment from win group by all)
 select doc_id, template, max(containment) as containment, min(first_word) filter (containment = best)::int as first_word
 from (select *, max(containment) over (partition by doc_id, template) as best from got) where best >= {share} group by doc_id, template"""


ORACLE_SQL: dict[str, str] = {
    "op1_url_trust_propagation": _url_trust_sql(),
    "op2_minhash_near_dedup": f"""with recursive w as ({_words("documents", "doc_id", _SPACED)}),
 sh as (select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')] else list_distinct(list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+3], ' '))) end) as s from w),
 n as (select doc_id, count(*) as n from sh group by doc_id),
 shared as (select x.doc_id as a, y.doc_id as b, count(*) as c from sh x join sh y on x.s = y.s and x.doc_id <> y.doc_id group by all),
 links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)), nodes as (select doc_id as id from documents), {_REACH}
 select d.doc_id, coalesce(n.n, 0) as n_shingles, root as component_id, root = d.doc_id as kept from documents d join roots on roots.id = d.doc_id left join n on n.doc_id = d.doc_id""",
    "op3_flat_graph_near_dedup": f"""with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where embedding is not null and label is not null),
 u as (select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
 links as (select x.vec_id as a, y.vec_id as b from u x join u y on x.label = y.label and len(x.e) = len(y.e) and x.vec_id <> y.vec_id where list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.93),
 nodes as (select vec_id as id from embeddings), {_REACH}
 select e.vec_id, (select count(*) from links where a = e.vec_id) as n_links, root as component_id, root = e.vec_id as kept, true as audit_passed from embeddings e join roots on roots.id = e.vec_id""",
    "op4_benchmark_decontamination": f"""with d as ({_words("documents", "doc_id", _PLAIN)}), i as ({_words("benchmark", "item_id", _PLAIN)}),
 win as (select item_id, o - 1 as o, least(10, len(ws)) as n, ws[o:o + least(10, len(ws)) - 1] as wl from (select item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) as o from i where len(ws) > 0)),
 lens as (select distinct n from win),
 dw as (select doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') as s from (select doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as p from d, lens where len(ws) >= n)),
 hit as (select distinct doc_id, p, win.n, item_id from dw join win on win.n = dw.n and array_to_string(wl, ' ') = s),
 spots as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(generate_series(p, p + n - 1)) as q from hit) group by doc_id),
 items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as listed from hit group by doc_id),
 pos as (select doc_id, unnest(generate_series(1, len(ws))) as p, unnest(ws) as w from d),
 freq as (select w, count(*) as f from pos group by w),
 wu as (select row_number() over () as wid, item_id, n, wl from win),
 ww as (select wid, item_id, n, unnest(generate_series(0, n - 1)) as j, unnest(wl) as w from wu),
 wf as (select ww.*, f, row_number() over (partition by wid order by f, j) as rarity from ww left join freq using (w)),
 ok as (select wid from wf group by wid having count(f) = any_value(n)),
 lead as (select doc_id, wid, item_id, n, p - j as start from wf join pos using (w) where rarity = 1 and wid in (select wid from ok)),
 near as (select distinct l.doc_id, l.item_id from (select l.doc_id, l.wid, l.item_id, l.n, l.start, count(distinct wf.j) as c from lead l join wf on wf.wid = l.wid join pos q on q.doc_id = l.doc_id and q.w = wf.w and q.p between l.start + wf.j - case when wf.rarity = 1 then 0 else 2 end and l.start + wf.j + case when wf.rarity = 1 then 0 else 2 end group by all) l where c = n),
 nn as (select doc_id, count(*) as n_near_items from near group by doc_id)
 select d.doc_id, len(d.ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near_items, 0) as n_near_items
 from d left join spots using (doc_id) left join items using (doc_id) left join nn using (doc_id)""",
    "op5_stupid_backoff": f"""with d as ({_words("documents", "doc_id", _SPACED)}),
 pos as (select doc_id, unnest(generate_series(1, len(ws))) as p, unnest(ws) as w from d),
 tri as (select doc_id, p, w, lag(w) over (partition by doc_id order by p) as v, lag(w, 2) over (partition by doc_id order by p) as u from pos),
 u1 as (select w, count(*) as c from pos group by w), ud as (select doc_id, w, count(*) as c from pos group by all),
 b1 as (select v, w, count(*) as c from tri where v is not null group by all), bd as (select doc_id, v, w, count(*) as c from tri where v is not null group by all),
 t1 as (select u, v, w, count(*) as c from tri where u is not null group by all), td as (select doc_id, u, v, w, count(*) as c from tri where u is not null group by all),
 total as (select count(*) as n from pos), size as (select doc_id, count(*) as n from pos group by doc_id),
 x as (select t.doc_id, t.p, t.v is not null as has2, t.u is not null as has3, u1.c - ud.c as cw, coalesce(b1.c - bd.c, 0) as cb, coalesce(uv.c - udv.c, 0) as cv, coalesce(t1.c - td.c, 0) as ct, coalesce(bv.c - bdv.c, 0) as cuv, total.n - size.n as rest
  from tri t join u1 on u1.w = t.w join ud on ud.doc_id = t.doc_id and ud.w = t.w join total on true join size on size.doc_id = t.doc_id
  left join b1 on b1.v = t.v and b1.w = t.w left join bd on bd.doc_id = t.doc_id and bd.v = t.v and bd.w = t.w left join u1 uv on uv.w = t.v left join ud udv on udv.doc_id = t.doc_id and udv.w = t.v
  left join t1 on t1.u = t.u and t1.v = t.v and t1.w = t.w left join td on td.doc_id = t.doc_id and td.u = t.u and td.v = t.v and td.w = t.w
  left join b1 bv on bv.v = t.u and bv.w = t.v left join bd bdv on bdv.doc_id = t.doc_id and bdv.v = t.u and bdv.w = t.v),
 s as (select doc_id, case when has3 and ct > 0 then ln(ct::double / cuv) else case when has3 then ln(0.4::double) else 0 end
   + case when has2 and cb > 0 then ln(cb::double / cv) else ln((cw + 1)::double / (rest + 1)) + case when has2 then ln(0.4::double) else 0 end end end as score,
   not (has3 and ct > 0 or has2 and cb > 0) as alone from x)
 select d.doc_id, len(d.ws) as n_words, coalesce(a.n_alone, 0) as n_alone, round(a.m, 6) as mean_log_score from d left join (select doc_id, count(*) filter (alone) as n_alone, avg(score) as m from s group by doc_id) a on a.doc_id = d.doc_id""",
    "op9_license_scan": _license_sql(),
    "op10_chunked_warc": """with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
 b as (select page_id, payload_bytes, h, array_to_string(list_transform(generate_series(0, 7), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * i + 1, 5))::int >> s) & 31) + 1, 1)), '')), '') as payload_digest from p),
 m as (select h, max(page_id) as top from b group by h)
 select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from b join m using (h)""",
}
