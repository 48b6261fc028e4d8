"""The queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import boilerplate, lines, packing, pages, pieces, reading, residue, scans, tokens, vectors
from corpusloom.operators.incremental import WHITE_SPACE
from corpusloom.session import materialize, spread, table


def _texts(spark, folder, kind=None):
    return pages.ok_texts(table(spark, folder, "resource"), table(spark, folder, "resource_text"), kind)


def _documents(spark, folder, *columns):
    return spread(table(spark, folder, "documents").select("doc_id", "text", *columns))


def _judged(spark, folder, kind):
    """The documents and the verdict on each."""
    found = pages.texts_of(table(spark, folder, "resource"), table(spark, folder, "resource_text"), kind)
    exemplars = residue.read_exemplars()
    seen = boilerplate.analyse(found, residue.Index(*residue.document_frequencies(found, exemplars), exemplars))
    return found, boilerplate.verdicts(seen, *boilerplate.site_model(seen.where("kind = 'page'"), table(spark, folder, "resource").where("kind = 'page'")))


def p2_found(spark, folder):
    return _judged(spark, folder, "page")[1].where("not bare").select("resource_id", F.explode("frame").alias("line_no"))


def p2_articles(spark, folder):
    found, judged = _judged(spark, folder, "page")
    kept = F.filter(F.split("text", "\n", -1), lambda x, n: ~F.array_contains("frame", n))
    article = F.when(F.col("bare"), "").otherwise(F.btrim(F.array_join(kept, "\n"), F.lit(WHITE_SPACE)))
    return found.select("resource_id", "text").dropDuplicates(["resource_id"]).join(judged, "resource_id").select("resource_id", article.alias("text"))


def p4_found(spark, folder):
    return _judged(spark, folder, None)[1].where("residue").select("resource_id")


def p3_found(spark, folder):
    return pieces.window_pieces(spread(table(spark, folder, "resource_text")))


def p3_content_pieces(spark, folder):
    return pieces.content_pieces(spread(table(spark, folder, "resource_text")))


def _pages(spark, folder):
    return pages.texts_of(table(spark, folder, "resource"), table(spark, folder, "resource_text"), "page")


def p5_found(spark, folder):
    found = lines.hashed(_pages(spark, folder))
    return lines.occurrences(found, lines.repeated_lines(found))


def p5_clusters(spark, folder):
    """As p5_found, but a line must be repeated over distinct texts that were published on two days or more."""
    found = lines.hashed(_pages(spark, folder))
    return lines.occurrences(found, lines.repeated_lines(found, unit="clusters", days=2))


def p5_cleaned(spark, folder):
    documents = _pages(spark, folder)
    found = lines.hashed(documents)
    return lines.without_repeated(documents, found, lines.repeated_lines(found))


def p6_found(spark, folder):
    return vectors.similar(table(spark, folder, "chunk").select("id", "embedder", "embedding"))


def p7_found(spark, folder):
    return scans.diagnose(_texts(spark, folder, "document"))[0]


def p7_paragraphs(spark, folder):
    return scans.paragraphs(_texts(spark, folder, "document"))


def p8_ids(spark, folder):
    return tokens.token_ids(_documents(spark, folder), "doc_id", "text")


def p8_decoded(spark, folder):
    """Every text through a deep tree of ids and back: its hash."""
    ids = tokens.token_ids(_documents(spark, folder), "doc_id", "text", leaf=256)
    return tokens.decoded(ids, "doc_id", "ids").select("doc_id", F.sha2("text", 256).alias("sha256"))


def p9_containers(spark, folder):
    return packing.pack(materialize(packing.items(_documents(spark, folder))))


def p10_levels(spark, folder):
    documents = _documents(spark, folder, "lang")
    return reading.score(documents, *reading.fit(documents, table(spark, folder, "reading_label")))


def p10_found(spark, folder):
    return p10_levels(spark, folder).where("demanding").select("doc_id").distinct()


def queries():
    return {f.__name__: f for f in (p2_found, p2_articles, p3_found, p3_content_pieces, p4_found, p5_found, p5_clusters, p5_cleaned, p6_found, p7_found, p7_paragraphs, p8_ids, p8_decoded, p9_containers, p10_found, p10_levels)}


_SPACE = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_PAGES = "p as (select distinct r.id, r.host, t.text from resource r join resource_text t on t.resource_id = r.id where r.kind = 'page' and t.status = 'ok')"
_LINES = rf"""{_PAGES},
l as (select id, host, line, line_no - 1 as line_no from (
        select id, host, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from p)),
f as (select *, regexp_replace(trim(regexp_replace(lower(line), '{_SPACE}+', ' ', 'g')), '[0-9]+', '0', 'g') as form from l),
n as (select host, count(*) as pages from p group by 1),
c as (select host, form from f join n using (host) where form <> '' group by host, form, pages
      having count(distinct id) >= 3 and count(distinct id) >= 0.05 * pages)"""


def oracle_sql():
    days = "p as (select id, host, text, coalesce(last_changed_at, first_seen_at)::timestamp::date as day from (select distinct r.id, r.host, t.text, r.last_changed_at, r.first_seen_at from resource r join resource_text t on t.resource_id = r.id where r.kind = 'page' and t.status = 'ok'))"
    clusters = _LINES.replace(_PAGES, days).replace("n as (select host, count(*) as pages", "k as (select host, text, min(day) as day, min(id) as id from p group by 1, 2),\nn as (select host, count(*) as pages").replace("from p group by 1),", "from k group by 1),")
    clusters = clusters.replace("from f join n using (host) where", "from f join k using (id, host) join n using (host) where").replace(">= 0.05 * pages)", ">= 0.05 * pages and count(distinct day) >= 2)")
    usable = "k as (select distinct on (id) id, embedder, embedding::double[] as v from chunk where embedding is not null and list_inner_product(embedding::double[], embedding::double[]) > 0)"
    near = f"with {usable}, s as (select a.id as i, b.id as j, round(list_cosine_similarity(a.v, b.v), 9) as c from k a join k b on a.embedder = b.embedder and len(a.v) = len(b.v) and a.id <> b.id), r as (select *, row_number() over (partition by i order by c desc, j) as n from s where c >= 0.8)"
    return {
        "p6_found": f"{near} select distinct least(i, j) as chunk_id_a, greatest(i, j) as chunk_id_b from r where n <= 5",
        "p8_decoded": "select doc_id, sha256(coalesce(text, '')) as sha256 from documents",
        "p5_clusters": f"with {clusters} select f.id as resource_id, line_no from f join c using (host, form)",
        "p5_found": f"with {_LINES} select id as resource_id, line_no from f join c using (host, form)",
        "p5_cleaned": f"""with {_LINES}
select id as resource_id, coalesce(string_agg(line, chr(10) order by line_no) filter (where c.form is null), '') as text
from f left join c using (host, form) group by id""",
    }
