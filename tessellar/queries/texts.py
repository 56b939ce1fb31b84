"""Text, page and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellar.bindings import bind
from tessellar.functions import scalars as S
from tessellar.operators import intelligence as I
from tessellar.operators import text as T
from tessellar.operators import vectors as V
from tessellar.operators.pattern_tables import LEXICON
from tessellar.queries import query


@query("""select doc_id, md5(x) as digest, cast(length(x) as bigint) as n from (select doc_id, case when length(y) >= 50 then y end as x from (select doc_id, trim(regexp_replace(regexp_replace(text, ' {2,}', ' ', 'g'), '\\n{3,}', E'\\n\\n', 'g'), E' \\n') as y from {documents}) a) b""")
def normalize_text(spark, d):
    rows = bind(spark, d, "documents").withColumn("x", T.normalize(F.col("text")))
    return rows.select("doc_id", F.md5(F.col("x").cast("binary")).alias("digest"), F.length("x").cast("bigint").alias("n"))


@query("select page_id, md5(regexp_replace(lower(trim(url)), '/+$', '')) as key from {pages}")
def url_key(spark, d):
    return bind(spark, d, "pages").select("page_id", S.url_key(F.col("url")).alias("key"))


@query("select doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) as key from {documents}")
def content_key(spark, d):
    return bind(spark, d, "documents").select("doc_id", S.content_key(F.col("text")).alias("key"))


@query("""select doc_id, case when ru > 1 then 'URL_DUPLICATE' when rc > 1 then 'CONTENT_DUPLICATE' else 'NEW' end as status from (select *, row_number() over (partition by c, ru = 1 order by doc_id) as rc from (
          select doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) as c, row_number() over (partition by lower('http://x.example/' || doc_id % 700) order by doc_id) as ru from {documents}) x) y""")
def dedup_exact(spark, d):
    docs = bind(spark, d, "documents").withColumn("url", F.concat(F.lit("http://X.example/"), (F.col("doc_id") % 700).cast("string")))
    return T.dedupe(docs, "doc_id").select("doc_id", "status")


@query("""select doc_id, cast(greatest(ceil((n - 50) / 350.0), 1) as bigint) as chunks from (select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as n from {documents}) x where n > 0""")
def chunk_counts(spark, d):
    return bind(spark, d, "documents").select("doc_id", F.size(T.chunks(F.col("text"))).cast("bigint").alias("chunks"))


_LEX = "select * from (values ('the', 'STOP'), ('eau', 'WATER'), ('und', 'STOP'), ('idiot', 'INSULT'), ('licensed under', 'LEGAL')) t(keyword, entity_type)"


@query(f"""select distinct doc_id, keyword, entity_type from {{documents}}, ({_LEX}) l where list_contains(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), keyword) or (keyword like '% %' and regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || keyword || '($|[^\\p{{L}}\\p{{N}}_])'))""")
def keyword_entities(spark, d):
    return T.keyword_entities(bind(spark, d, "documents"), spark.sql(_LEX))


_OWN = "select * from (values " + ", ".join(f"('{w}', '{kind}')" for kind, _, words in LEXICON for w in words) + ") t(keyword, entity_type)"


@query(f"""select distinct doc_id, keyword, entity_type from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')) as w from {{documents}}) x join ({_OWN}) l on w = lower(keyword)
           union select doc_id, keyword, entity_type from {{documents}}, ({_OWN}) l where regexp_matches(keyword, '[^A-Za-z0-9]') and case when contains(lower(text), lower(keyword))
           then regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])' || replace(lower(keyword), '+', '\\+') || '($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') else false end""")
def lexicon_entities(spark, d):
    return T.keyword_entities(bind(spark, d, "documents"))


@query("select doc_id, substr(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: length(l) > 5)[1], 1, 200) as title from {documents}")
def title_extract(spark, d):
    return bind(spark, d, "documents").select("doc_id", T.title(F.col("text")).alias("title"))


_BM25 = """select doc_id, floor(score * 1e6 + 0.5) / 1e6 as score from (select doc_id, """ + " + ".join(
    f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1.0) * tf{i} * 2.2 / (tf{i} + 1.2 * (1.0 - 0.75 + 0.75 * length / mean))" for i in range(2)
) + """ as score from (select doc_id, cast(len(w) as double) as length, cast(len(list_filter(w, lambda x: x = 'thea')) as double) as tf0, cast(len(list_filter(w, lambda x: x = 'license')) as double) as tf1 from (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') as w from {documents}) a) c,
    (select cast(count(*) as double) as n, avg(len(w)) as mean, cast(count(*) filter (where list_contains(w, 'thea')) as double) as df0, cast(count(*) filter (where list_contains(w, 'license')) as double) as df1 from (select list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') as w from {documents}) b) s) z where score > 0 order by floor(z.score * 1e9) desc, doc_id limit 20"""


@query(_BM25)
def search_bm25(spark, d):
    out = T.search(bind(spark, d, "documents"), ["thea", "license"])
    return out.select("doc_id", S.q(F.col("score"), 6).alias("score"))


@query(_BM25)
def search_index(spark, d):
    docs = bind(spark, d, "documents")
    out = T.search_postings(T.postings(docs), T.totals(docs), ["thea", "license"])
    return out.select("doc_id", S.q(F.col("score"), 6).alias("score"))


@query("""select doc_id, n_chars from {documents} where contains(lower(text), 'licensed under') order by n_chars desc nulls last, doc_id limit 20""")
def search_without_index(spark, d):
    return T.search_phrase(bind(spark, d, "documents"), "Licensed under", "n_chars").select("doc_id", "n_chars")


@query("""select term, cast(count(*) as bigint) as documents, cast(sum(tf) as bigint) as uses from (select doc_id, t as term, count(*) as tf from (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) as t from {documents}) a group by 1, 2) b group by 1 having count(*) >= 50""")
def postings(spark, d):
    rows = T.postings(bind(spark, d, "documents"))
    return rows.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("uses")).filter("documents >= 50")


@query("""select b.item_id, d.doc_id from {benchmark} b join {documents} d on contains(d.text, b.text)""")
def benchmark_containment(spark, d):
    """Passages contained in documents: candidates share the passage's rarest-looking (longest) word, then the text is compared."""
    b = bind(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    words = bind(spark, d, "documents").select("doc_id", "text", F.explode(F.array_distinct(F.split("text", r"[ \n]"))).alias("__w"))
    # inner words of a passage stand whole in the text; the longest may sit at its edge, so its edges are left out
    parts = F.split("passage", r"[ \n]")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(1)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = b.withColumn("__w", longest)
    return words.join(keyed, "__w").filter(F.contains("text", F.col("passage"))).select("item_id", "doc_id").distinct()


@query("""select doc_id, p - n as lead, floor(case when p + n > 0 then cast(p - n as double) / (p + n) else 0.0 end * 1e4 + 0.5) / 1e4 as mood from (select doc_id, cast(contains(lower(text), 'the') as int) + cast(contains(lower(text), 'tion') as int) as p, cast(contains(lower(text), 'eau') as int) + cast(contains(lower(text), 'ein') as int) as n from {documents}) x""")
def sentiment_scores(spark, d):
    pos, neg = ("the", "tion"), ("eau", "ein")
    t = F.col("text")
    return bind(spark, d, "documents").select("doc_id", (T.phrase_hits(t, pos) - T.phrase_hits(t, neg)).alias("lead"), S.q(T.sentiment(t, pos, neg)).alias("mood"))


@query("""select doc_id, role, cast(hits as integer) as hits from (select doc_id, unnest([{'role': 'supplier', 'hits': len(regexp_extract_all(lower(text), 'thea|onan'))}, {'role': 'beneficiary', 'hits': len(regexp_extract_all(lower(text), 'eau(x)?'))}], recursive := true) from {documents}) x where hits > 0""")
def role_hits(spark, d):
    patterns = {"supplier": ("thea", "onan"), "beneficiary": ("eau(x)?",)}
    rows = bind(spark, d, "documents").select("doc_id", F.explode(I.roles(F.col("text"), patterns)).alias("r"))
    return rows.select("doc_id", "r.role", "r.hits").filter("hits > 0")


@query("""select doc_id, role from (select doc_id, unnest(case when contains(lower(text), 'infrastructure') then ['infrastructure_provider'] else ['beneficiary'] end) as role from {documents}) x""")
def company_roles(spark, d):
    return bind(spark, d, "documents").select("doc_id", F.explode(I.roles(F.col("text"))).alias("r")).select("doc_id", "r.role")


_CENTRE = "select label, list(m order by pos) as c from (select label, pos, floor(avg(x) * 1e5 + 0.5) / 1e5 as m from (select label, unnest(embedding) as x, unnest(range(len(embedding))) as pos from {embeddings}) y group by 1, 2) z group by 1"
_DOT = "list_sum(list_transform(list_zip(a.c, b.embedding), lambda p: cast(p[1] as double) * cast(p[2] as double)))"
_SIZE = "list_sum(list_transform({}, lambda p: cast(p as double) * cast(p as double)))"
_COS = f"{_DOT} / (sqrt({_SIZE.format('a.c')}) * sqrt({_SIZE.format('b.embedding')}))"


@query(f"""select label, vec_id, floor(score * 1e6 + 0.5) / 1e6 as score, rank from (select a.label, b.vec_id, {_COS} as score, row_number() over (partition by a.label order by floor({_COS} * 1e9) desc, b.vec_id) as rank
           from {{embeddings}} b, ({_CENTRE}) a) x where rank <= 20""")
def cosine_topk(spark, d):
    """The vectors nearest to each label's centroid."""
    e = bind(spark, d, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(S.q(F.avg(F.col("x").cast("double")), 5).alias("m"))
    centres = parts.groupBy(F.col("label").alias("query")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vector"))
    out = V.exact_topk(e, "vec_id", "embedding", centres, 20)
    return out.select(F.col("query").alias("label"), F.col("key").alias("vec_id"), S.q(F.col("score"), 6).alias("score"), "rank")


@query("""select label, pos, floor(avg(x) * 1e5 + 0.5) / 1e5 as mean from (select label, unnest(embedding) as x, unnest(range(len(embedding))) as pos from {embeddings}) y group by 1, 2""")
def centroid_by_label(spark, d):
    rows = V.centroid(bind(spark, d, "embeddings"), ["label"], "embedding").select("label", F.posexplode("centroid").alias("pos", "x"))
    return rows.select("label", F.col("pos").cast("bigint").alias("pos"), S.q(F.col("x"), 5).alias("mean"))


@query("""select page_id, cast(length(x) > 0 as boolean) as has_text, md5(x) as digest from (select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style[^>]*>.*?</style\\s*>', ' ', 'g'),
          '(?is)<header[^>]*>.*?</header\\s*>', ' ', 'g'), '(?is)<footer[^>]*>.*?</footer\\s*>', ' ', 'g'), '(?is)<nav[^>]*>.*?</nav\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) as x from {pages}) y""")
def html_text(spark, d):
    rows = bind(spark, d, "pages").withColumn("x", T.html_text(F.col("html")))
    return rows.select("page_id", (F.length("x") > 0).alias("has_text"), F.md5(F.col("x").cast("binary")).alias("digest"))


@query("select c_custkey, trim(regexp_replace(regexp_replace(lower(c_name || ' Inc.'), '[.,]', '', 'g'), '\\s+(inc)$', '')) as name, substr(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 30) as slug from {customer}")
def company_names(spark, d):
    c = bind(spark, d, "customer")
    return c.select("c_custkey", S.strip_suffix(F.concat("c_name", F.lit(" Inc."))).alias("name"), S.slug(F.col("c_name")).alias("slug"))


@query("select o_orderkey, cast(o_orderdate as date) as parsed from {orders}")
def date_formats(spark, d):
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "dd-MM-yyyy")).when(k == 2, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd MMM yyyy"))
    return bind(spark, d, "orders").select("o_orderkey", S.parse_date(text).alias("parsed"))


@query("""select p_partkey, lower(p_name) as name, case when p_brand = 'Brand#1' then p_type else p_brand end as company from {part}""")
def null_company_key(spark, d):
    brand = F.when(F.col("p_brand") == "Brand#1", "").otherwise(F.col("p_brand"))
    return bind(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name"), S.company_key(brand, F.col("p_type")).alias("company"))
