"""G: corpus preparation on the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.functions import text as X
from evenhand.functions.stats import rnd, small
from evenhand.operators import corpus as K
from evenhand.plans import source_queries as A
from evenhand.plans.registry import query
from evenhand.sources import readers as S
from evenhand.sources import tables as T


def headed(spark, sf):
    """Documents with short lines turned into headings and page markers before some lines."""
    t = F.regexp_replace("text", r"(^|\n)([^\n]{1,24})\.(\n|$)", "$1## $2$3")
    t = F.regexp_replace(t, r"\n(Th|D)", "\n[page 2] $1")
    t = F.regexp_replace(t, r"\n(L|E)", "\n[page 3]\n$1")
    return T.table(spark, sf, "documents").select("doc_id", "source", t.alias("text"))


HEADED = r"""hd as (select doc_id, source, regexp_replace(regexp_replace(regexp_replace(text, '(^|\n)([^\n]{1,24})\.(\n|$)', '\1## \2\3', 'g'), '\n(Th|D)', chr(10)||'[page 2] \1', 'g'), '\n(L|E)', chr(10)||'[page 3]'||chr(10)||'\1', 'g') t from documents)"""
# sections line by line: the running heading count and the last page seen, as windows
SECTIONS = HEADED + r""",
 ln as (select doc_id, source, unnest(string_split(t, chr(10))) line, unnest(range(len(string_split(t, chr(10))))) i from hd),
 l2 as (select *, line like '## %' h, sum(case when line like '## %' then 1 else 0 end) over (partition by doc_id order by i) part_no, nullif(regexp_extract(line, '\[page (\d+)\]', 1),'') pg,
   regexp_replace(case when line like '## %' then '' else line end, '\[page \d+\]', '', 'g') txt from ln),
 l3 as (select *, last_value(pg ignore nulls) over (partition by doc_id order by i) seen, min(case when not h and trim(txt)<>'' then i end) over (partition by doc_id, part_no) first_text,
   min(i) over (partition by doc_id, part_no) first_line from l2),
 l4 as (select doc_id, any_value(source) source, part_no, max(case when h then trim(regexp_replace(substr(line,4), '\[page \d+\]', '', 'g')) end) title,
   max(case when i=first_line then coalesce(case when h then lag_seen end,'') end) prev, max(case when h then pg end) head_pg,
   coalesce(arg_min(case when not h and (first_text is null or i<=first_text) and (pg is not null) then pg end, i),'') lead_pg,
   trim(string_agg(case when h then null else txt end, ' ' order by i)) body from (select *, lag(seen) over (partition by doc_id order by i) lag_seen from l3) group by doc_id, part_no),
 sx as (select doc_id, source, part_no, coalesce(title,'Untitled') section, case when lead_pg<>'' then lead_pg when head_pg is not null then head_pg else coalesce(prev,'') end page, body from l4 where body<>'')"""


@query("g01_sections", "with " + SECTIONS + " select doc_id, count(*) n, cast(sum(length(body)) as bigint) chars, cast(sum(part_no) as bigint) part_sum, string_agg(page, ',' order by part_no) pages, md5(string_agg(section, '|' order by part_no)) titles from sx group by 1")
def g01(spark, sf):
    s = K.split_sections(headed(spark, sf))
    rows = F.array_sort(F.collect_list(F.struct("part_no", "page", "section")))
    return s.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("body").cast("bigint")).alias("chars"), F.sum(F.col("part_no").cast("bigint")).alias("part_sum"),
        F.array_join(F.transform(rows, lambda r: r["page"]), ",").alias("pages"), F.md5(F.array_join(F.transform(rows, lambda r: r["section"]), "|")).alias("titles"))


# packing written as a recursion over the sentence number
CHUNKS = SECTIONS + r""",
 st as (select doc_id, part_no, unnest(string_split(regexp_replace(body, '([.!?])\s+', '\1'||chr(1), 'g'), chr(1))) s, unnest(range(len(string_split(regexp_replace(body, '([.!?])\s+', '\1'||chr(1), 'g'), chr(1))))) j from sx),
 sw as (select doc_id, part_no, j, list_filter(regexp_split_to_array(trim(s), '\s+'), lambda w: w<>'') w from st),
 pc as (select doc_id, part_no, j, q, list_slice(w, q*40+1, q*40+40) w from sw, unnest(range(greatest(1, cast(ceil(len(w)/40.0) as int)))) u(q) where len(w)>0),
 pn as (select *, row_number() over (partition by doc_id, part_no order by j, q) k, len(w) n from pc)"""
CHUNKS_REC = CHUNKS + r""",
 rc as (select doc_id, part_no, k, 0 chunk_no, n used from pn where k=1 union all
   select pn.doc_id, pn.part_no, pn.k, case when rc.used+pn.n>40 then rc.chunk_no+1 else rc.chunk_no end, case when rc.used+pn.n>40 then pn.n else rc.used+pn.n end from rc join pn on pn.doc_id=rc.doc_id and pn.part_no=rc.part_no and pn.k=rc.k+1),
 ck as (select pn.doc_id, pn.part_no, chunk_no, sum(n) n_words, string_agg(array_to_string(w,' '), ' ' order by k) text from pn join rc using (doc_id, part_no, k) group by 1,2,3)"""


@query("g02_sentence_chunks", "with recursive " + CHUNKS_REC + " select doc_id, count(*) n, cast(sum(n_words) as bigint) words, cast(max(n_words) as bigint) longest, min(md5(text||cast(chunk_no as varchar))) fingerprint from ck group by 1")
def g02(spark, sf):
    c = K.sentence_chunks(K.split_sections(headed(spark, sf)), 40)
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_words").cast("bigint")).alias("words"), F.max(F.col("n_words").cast("bigint")).alias("longest"),
                                   F.min(F.md5(F.concat("text", F.col("chunk_no").cast("string")))).alias("fingerprint"))


@query("g02_chunk_ids")
def g02_ids(spark, sf):
    docs = S.part_numbers(headed(spark, sf)).withColumn("text", F.col("text"))
    c = K.sentence_chunks(K.split_sections(docs, keys=("doc_id", "source", "part")), 400, ("doc_id", "source", "part", "part_no"))
    ids = c.withColumn("chunk_id", K.chunk_ids(c))
    return ids.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("distinct_ids"), F.min("chunk_id").alias("first_id"))


def _refs_sql(c):
    marks = [(f"len(regexp_extract_all({c},'{X.for_sql(pattern)}'))", least, per, worth) for _, pattern, least, per, worth in K.REFERENCE_MARKS]
    return f"(length({c})>=80 and " + " + ".join(f"(case when {n}>={least} and {n}*100>{per}*length({c}) then {worth} else 0 end)" for n, least, per, worth in marks) + " >= 2)"


@query("g03_character_chunks", r"""with fl as (select doc_id, trim(regexp_replace(text,'\s+',' ','g')) t from documents),
 wi as (select doc_id, k, k*580 start, substr(t, k*580+1, 700) p from fl, unnest(range(1+greatest(0, cast(ceil((length(t)-700)/580.0) as int)))) u(k) where length(t)>0),
 cu as (select doc_id, k, start, case when start>0 and strpos(p,' ') between 1 and 40 then substr(p, strpos(p,' ')+1) else p end c from wi where length(trim(p))>=60)
 select doc_id, count(*) n, cast(sum(length(trim(c))) as bigint) chars, cast(sum(start) as bigint) starts, min(md5(trim(c))) fingerprint from cu where not """ + _refs_sql("c") + " group by 1")
def g03(spark, sf):
    c = K.character_chunks(T.table(spark, sf, "documents"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars"), F.sum(F.col("start").cast("bigint")).alias("starts"), F.min(F.md5("text")).alias("fingerprint"))


WINDOWS = r"""wd as (select doc_id, list_filter(regexp_split_to_array(trim(text),'\s+'), lambda w: w<>'') w from documents),
 ww as (select doc_id, k as "window", array_to_string(list_slice(w, k*200+1, k*200+250),' ') text from wd, unnest(range(1+greatest(0, cast(ceil((len(w)-250)/200.0) as int)))) u(k))"""


@query("g04_word_windows", "with " + WINDOWS + ' select doc_id, count(*) n, cast(sum(length(text)) as bigint) chars, min(md5(text)) fingerprint from ww group by 1')
def g04(spark, sf):
    w = K.word_windows(T.table(spark, sf, "documents"))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars"), F.min(F.md5("text")).alias("fingerprint"))


_CITED = r"""case when lang='fr' then regexp_replace(text, '([A-Z])', '12. \1','g') when lang='de' then 'Smith J, Doe AB, '||replace(text,'.',';')||' et al.' else text end"""


@query("g05_reference_filter", f"with q as (select lang, {_CITED} c from documents) select lang, {_refs_sql('c')} is_reference, count(*) n from q group by all")
def g05(spark, sf):
    c = F.when(F.col("lang") == "fr", F.regexp_replace("text", "([A-Z])", "12. $1")).when(
        F.col("lang") == "de", F.concat(F.lit("Smith J, Doe AB, "), F.replace(F.col("text"), F.lit("."), F.lit(";")), F.lit(" et al."))).otherwise(F.col("text"))
    q = T.table(spark, sf, "documents").select("lang", c.alias("c"))
    return q.groupBy("lang", K.looks_like_references(F.col("c")).alias("is_reference")).agg(F.count(F.lit(1)).alias("n"))


def _clean_sql(c):
    for _, pattern, by in K.REPAIRS:
        c = f"regexp_replace({c}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return f"trim({c}, ' '||chr(10))"


@query("g06_clean_text", f"with q as (select doc_id, {_clean_sql('replace(text, chr(46)||chr(10), chr(45)||chr(10))')} c from documents) select doc_id, length(c) n_chars, md5(c) fingerprint from q")
def g06(spark, sf):
    broken = F.replace(F.col("text"), F.lit(".\n"), F.lit("-\n"))
    return T.table(spark, sf, "documents").select("doc_id", K.clean_text(broken).alias("c")).select("doc_id", F.length("c").cast("bigint").alias("n_chars"), F.md5("c").alias("fingerprint"))


@query("g06_boilerplate", """with ln as (select source, doc_id, unnest(string_split(text,chr(10))) line from documents), ct as (select source, trim(line) l, count(distinct doc_id) n from ln where length(trim(line))>=12 group by 1,2),
 bp as (select ct.source, l from ct join (select source, count(*) p from documents group by 1) using (source) where p>=4 and n>0.05*p)
 select source, cast(sum(case when exists(select 1 from bp where bp.source=ln.source and bp.l=trim(ln.line)) then 1 else 0 end) as bigint) n_removed, cast(sum(case when exists(select 1 from bp where bp.source=ln.source and bp.l=trim(ln.line)) then 0 else length(line) end) as bigint) chars_left from ln group by 1""")
def g06_boilerplate(spark, sf):
    d = K.drop_boilerplate(T.table(spark, sf, "documents").select("doc_id", "source", "text"), threshold=0.05)
    return d.groupBy("source").agg(F.sum(F.col("n_removed").cast("bigint")).alias("n_removed"), F.sum(F.length(F.replace(F.col("clean"), F.lit("\n"), F.lit(""))).cast("bigint")).alias("chars_left"))


@query("g07_extraction_quality", r"""select source, lang, n_pages, letters, round(letters*1.0/n_pages,6) per_page, letters>=2000 and letters*1.0/n_pages>=250 usable,
 case when letters=0 then 'UNREADABLE' when letters*1.0/n_pages<200 then 'POOR' when letters*1.0/n_pages<800 then 'PARTIAL' else 'GOOD' end quality from
 (select source, lang, count(*) n_pages, cast(sum(length(regexp_replace(text,'[^\pL]','','g'))) as bigint) letters from documents group by all)""")
def g07(spark, sf):
    d = T.table(spark, sf, "documents").withColumn("key", F.struct("source", "lang"))
    return rnd(K.extraction_quality(d, "key").select("key.source", "key.lang", "n_pages", "letters", "per_page", "usable", "quality"))


DOSED = "replace(replace(text, ' of ', ' 5 mg '), ' le ', ' twice daily ')"
_DOSE_SQL = X.for_sql(X.DOSE)


def dosed(spark, sf):
    t = F.replace(F.replace(F.col("text"), F.lit(" of "), F.lit(" 5 mg ")), F.lit(" le "), F.lit(" twice daily "))
    return T.table(spark, sf, "documents").withColumn("text", t)


@query("g08_scrub_and_withhold", f"select doc_id, regexp_matches(t, '{_DOSE_SQL}') withheld, length(regexp_replace(t, '{_DOSE_SQL}', ' ', 'g')) indexed_chars from (select doc_id, {DOSED} t from documents)")
def g08(spark, sf):
    return dosed(spark, sf).select("doc_id", F.col("text").rlike(X.DOSE).alias("withheld"), F.length(X.dose_free(F.col("text"))).cast("bigint").alias("indexed_chars"))


@query("g09_source_labels", "with " + SECTIONS + "," + A.REG + r""", lb as (select source, concat_ws(', ', trim(concat_ws(' ', issuer, nullif(regexp_extract(version, '\b((?:19|20)\d{2})\b', 1),''))), case when trim(section)<>'' then '§ '||trim(section) end, case when page not in ('','?') then 'p.'||page end) label,
  """ + A.CLEARED_SQL + " ready from sx join reg on source=id) select source, ready, count(*) n, count(distinct label) labels, min(label) first_label from lb group by all")
def g09(spark, sf):
    s = K.split_sections(headed(spark, sf), keys=("doc_id", "source"))
    reg = A.register(spark).withColumnRenamed("id", "source")
    j = s.join(small(reg), "source").select("source", S.is_cleared().alias("ready"), K.source_label().alias("label"))
    return j.groupBy("source", "ready").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels"), F.min("label").alias("first_label"))


@query("g10_corpus_fingerprint", "select source, count(*) n, bit_xor(p) as xor, cast(sum(p%1000003) as bigint) as check_sum from (select source, ('0x'||substr(sha256(text),1,15))::bigint p from documents) group by 1")
def g10(spark, sf):
    p = K.fingerprints(T.table(spark, sf, "documents"), ["source", "doc_id"])
    return K.corpus_fingerprint(p, ["source"]).withColumnRenamed("check", "check_sum")


@query("g10_stale_index", "with " + WINDOWS + """, b as (select doc_id, lang from documents), sv as (select doc_id, "window", substr(sha256(text),1,16) sha from ww join b using (doc_id) where lang<>'de'),
 cu as (select doc_id, "window", substr(sha256(case when lang='es' then upper(text) else text end),1,16) sha from ww join b using (doc_id) where lang<>'fr')
 select case when sv.sha is null then 'new' when cu.sha is null then 'gone' else 'changed' end why, count(*) n, cast(sum(doc_id) as bigint) ids from sv full join cu using (doc_id, "window") where sv.sha is distinct from cu.sha group by 1""")
def g10_stale(spark, sf):
    d = T.table(spark, sf, "documents")
    saved = K.fingerprints(K.word_windows(d.where(F.col("lang") != "de")), ["doc_id", "window"])
    now = K.word_windows(d.where(F.col("lang") != "fr"), keys=("doc_id", "lang")).withColumn("text", F.when(F.col("lang") == "es", F.upper("text")).otherwise(F.col("text")))
    return K.stale_rows(saved, K.fingerprints(now, ["doc_id", "window"]), ["doc_id", "window"]).groupBy("why").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))
