"""Queries of vocabulary, claims, citations and editions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims, editions, lexical, pivots
from .bindings import SMALL as P
from .bindings import Views
from .drift_queries import query

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TERMS = rf""", words as (select article, side, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '\p{{L}}{{3,}}'))) term from texts),
terms as (select article, side, term, count(*) n from words where term not in ({_STOP}) group by all),
pairs as (select article, term, coalesce(sum(n) filter (where side = 'before'), 0)::bigint b, coalesce(sum(n) filter (where side = 'after'), 0)::bigint a from terms group by 1, 2),
tots as (select article, sum(b)::bigint tb, sum(a)::bigint ta from pairs group by 1), pt as (select * from pairs join tots using (article)),
js as (select article, round_even(sum(case when tb > 0 and ta > 0 then case when b > 0 then 0.5*(b/tb)*ln((b/tb)/(0.5*(b/tb + a/ta))) else 0 end + case when a > 0 then 0.5*(a/ta)*ln((a/ta)/(0.5*(b/tb + a/ta))) else 0 end else 0 end), 4) js_divergence, max(tb) before_tokens, max(ta) after_tokens from pt group by 1),
ad as (select *, round_even(greatest(before_tokens, after_tokens)/nullif(least(before_tokens, after_tokens), 0), 4) size_ratio from js),
ad2 as (select *, case when least(before_tokens, after_tokens) < {P.lexical_tokens} then 'token_floor' when size_ratio > {P.lexical_ratio} then 'size_ratio' end inadequacy from ad)"""


def _counts(v: Views) -> DataFrame:
    return lexical.term_counts(v.texts, "article", "side")


@query(_TERMS + " select article, side, term, n from terms")
def term_counts(v: Views) -> DataFrame:
    return _counts(v)


@query(r"select rev_id, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '\p{L}{3,}')))::int n, array_to_string(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '\p{L}{3,}'))[1:10], ' ') head from texts")
def tokenize(v: Views) -> DataFrame:
    return v.texts.select("rev_id", F.size(T.terms(F.col("text"))).alias("n"), F.array_join(F.slice(T.terms(F.col("text")), 1, 10), " ").alias("head"))


@query(_TERMS + " select * from js")
def js_divergence(v: Views) -> DataFrame:
    return lexical.js_divergence(lexical.paired(_counts(v)))


@query(_TERMS + """, lo as (select *, a - b delta, round_even(ln((a + 0.5)/(greatest(0, ta - a) + 0.5)) - ln((b + 0.5)/(greatest(0, tb - b) + 0.5)), 4) log_odds from pt where tb > 0 and ta > 0 and a + b >= 3 and a <> b),
ld as (select *, case when log_odds > 0 then 'gained' else 'lost' end direction from lo where log_odds <> 0)
select article, direction, row_number() over (partition by article, direction order by abs(log_odds) desc, case direction when 'gained' then -delta else delta end, term) "rank", term, b "before", a "after", delta, log_odds from ld qualify "rank" <= 20""")
def log_odds(v: Views) -> DataFrame:
    return lexical.log_odds(lexical.paired(_counts(v)))


@query(_TERMS + " select *, inadequacy is null adequate from ad2")
def baseline_adequacy(v: Views) -> DataFrame:
    return lexical.baseline_adequacy(lexical.js_divergence(lexical.paired(_counts(v))), P)


@query(_TERMS + """ select t.article, case when t.article in (select article from texts where rev_id % 97 = 0) then 'pivot_relative' else 'whole_history' end "mode", case when js_divergence is null then 'not_applicable' when inadequacy is null then 'available' else 'insufficient_baseline' end analysis_status,
  js_divergence, before_tokens, after_tokens, size_ratio, case when js_divergence is not null then inadequacy is null end adequate, inadequacy from (select distinct article from texts) t left join ad2 on ad2.article = t.article""")
def lexical_drift(v: Views) -> DataFrame:
    return lexical.lexical_drift(v.texts, v.texts.where("rev_id % 97 = 0"), P)


_SENTENCES = r"string_split(regexp_replace({}, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1))"


@query(f"""select rev_id, array_to_string(list_filter({_SENTENCES.format('text')}, lambda s: contains(lower(s), lower(string_split(text, ' ')[5]))), ' ')[1:6000] passage from texts""")
def focal_passage(v: Views) -> DataFrame:
    return v.texts.select("rev_id", T.focal_passage(F.col("text"), F.get(F.split("text", " "), F.lit(4))).alias("passage"))


def _stripped(column: str) -> str:
    for pattern, stays in T.MARKUP:
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{stays}', 'g')"
    return column


_CLAIMS = rf""", cl0 as (select article, rev_id, {_SENTENCES.format(_stripped('text'))} parts from texts), cl1 as (select article, rev_id, parts, unnest(range(len(parts)))::int unit_index from cl0),
cl2 as (select article, rev_id, unit_index, regexp_replace(trim(regexp_replace(parts[unit_index + 1], '[ \t\n\f\r]+', ' ', 'g'), ' '), ' +([.!?])', '\1', 'g') text from cl1),
claims as (select *, substr(sha256(lower(text)), 1, 20) claim_id from cl2 where text <> ''),
pr as (select * from (select article, lag(rev_id) over (partition by article order by rev_id) before_rev, rev_id after_rev from (select distinct article, rev_id from texts)) where before_rev is not null),
cb as (select p.*, claim_id, text, row_number() over (partition by p.article, before_rev, after_rev, claim_id order by unit_index) n from pr p join claims c on c.article = p.article and c.rev_id = before_rev),
ca as (select p.*, claim_id, text, row_number() over (partition by p.article, before_rev, after_rev, claim_id order by unit_index) n from pr p join claims c on c.article = p.article and c.rev_id = after_rev),
added as (select * from ca anti join cb using (article, before_rev, after_rev, claim_id, n))"""


def _claims(v: Views) -> tuple[DataFrame, DataFrame]:
    return claims.claim_units(v.texts), claims.revision_pairs(v.texts)


@query(_CLAIMS + " select article, rev_id, unit_index, claim_id, length(text)::int size from claims")
def claim_units(v: Views) -> DataFrame:
    return _claims(v)[0].select("article", "rev_id", "unit_index", "claim_id", F.length("text").alias("size"))


@query(_CLAIMS + " select article, before_rev, after_rev, claim_id, n from ca join cb using (article, before_rev, after_rev, claim_id, n)")
def claim_match(v: Views) -> DataFrame:
    return claims.claim_match(*_claims(v)).select(*claims.PAIR, "claim_id", "n")


def _drafts(v: Views) -> tuple[DataFrame, DataFrame]:
    drafts = v.drafts_in(v.text_parts())
    return claims.claim_units(drafts), claims.revision_pairs(drafts)


@query()
def claim_match_fuzzy(v: Views) -> DataFrame:
    """On states of each document; tests/test_claims.py holds it against a plain version."""
    return claims.claim_match_fuzzy(*_drafts(v), P)


@query()
def claim_transition(v: Views) -> DataFrame:
    """On states of each document; tests/test_claims.py holds it against a plain version."""
    return claims.claim_transition(*_drafts(v), P)


@query()
def claim_persistence(v: Views) -> DataFrame:
    """On states of each document; tests/test_claims.py holds it against a plain version."""
    return claims.claim_persistence(*_drafts(v), P)


def _tokens(v: Views) -> DataFrame:
    rows = v.table("documents").select(F.concat(F.lit("d"), "doc_id").alias("article"), "doc_id", F.posexplode(F.split("text", " ")).alias("pos", "str"))
    origin = F.pmod(F.col("doc_id") + F.floor(F.col("pos") / 7), F.lit(5))
    return rows.select("article", F.col("pos").cast("long").alias("pos"), "str", origin.alias("o_rev_id"), F.concat(F.lit("u"), F.pmod(origin, F.lit(3))).alias("author"))


_TOKENS = """, tk0 as (select doc_id, string_split(text, ' ') p from documents), tk1 as (select doc_id, unnest(range(len(p))) pos, unnest(p) str from tk0),
tk as (select 'd' || doc_id article, pos, str, (doc_id + pos // 7) % 5 o_rev_id, 'u' || ((doc_id + pos // 7) % 5) % 3 author from tk1)"""


@query(_TOKENS + """, c as (select *, case when o_rev_id is not distinct from lag(o_rev_id) over (partition by article order by pos) then 0 else 1 end cut from tk where pos < 1500), s as (select *, sum(cut) over (partition by article order by pos)::bigint span from c)
select article, span, min(pos) "start", count(*) n, any_value(o_rev_id) o_rev_id, string_agg(str, ' ' order by pos) "text" from s group by 1, 2""")
def blame_spans(v: Views) -> DataFrame:
    return claims.blame_spans(_tokens(v))


@query(_TOKENS + r", c as (select article, lower(str) word, author, count(*) n, min(pos) p from tk where regexp_full_match(str, '\p{L}{3,}') group by all) select article, word, arg_min(author, (-n, p)) author from c group by 1, 2")
def word_authors(v: Views) -> DataFrame:
    return claims.word_authors(_tokens(v))


@query()
def redline(v: Views) -> DataFrame:
    """Neighbouring drafts, with who wrote what went and what came; tests/test_pivots.py holds it against a plain version."""
    from .pivot_queries import draft_authors

    parts = v.text_parts()
    drafts = v.drafts_in(parts)
    return claims.redline(pivots.materialized_pivots(claims.revision_pairs(drafts), drafts, draft_authors(v, drafts), parts))


def _stances(v: Views) -> DataFrame:
    value = F.when(F.col("toxic") == 1, -1.0).when(F.col("quality") == 1, 1.0).otherwise(0.0)
    rows = v.texts.join(v.table("labels").select(F.col("doc_id").alias("rev_id"), value.alias("value")), "rev_id")
    return rows.groupBy(F.col("side").alias("variant"), F.col("article").alias("entity"), "lang").agg(F.avg("value").alias("value"))


_STANCES = ", st as (select side variant, article entity, lang, avg(case when toxic = 1 then -1.0::double when quality = 1 then 1.0 else 0.0 end) as value from texts join labels on doc_id = rev_id group by 1, 2, 3)"


@query(_STANCES + ", sp as (select variant, entity, max(value) - min(value) s from st group by 1, 2 having count(distinct lang) >= 2) select variant, round_even(avg(s), 2) divergence, count(*) entities from sp group by 1")
def static_divergence(v: Views) -> DataFrame:
    return editions.static_divergence(_stances(v))


_GAP = _STANCES + ", g as (select variant, entity, abs(avg(value) filter (where lang = 'en') - avg(value) filter (where lang <> 'en')) gap from st group by 1, 2), gg as (select variant, round_even(avg(gap), 2) gap from g where gap is not null group by 1)"


@query(_GAP + " select * from gg")
def en_gap(v: Views) -> DataFrame:
    return editions.en_gap(_stances(v))


@query("select b, a, case when a - b > 0.25 then 'PEELED AWAY' when b - a > 0.25 then 'converged' else 'no net change' end reading from (select c_custkey % 7 / 4.0::double b, c_custkey % 5 / 4.0::double a from customer)")
def read_gap(v: Views) -> DataFrame:
    rows = v.table("customer").select((F.pmod("c_custkey", F.lit(7)) / F.lit(4.0)).alias("b"), (F.pmod("c_custkey", F.lit(5)) / F.lit(4.0)).alias("a"))
    return rows.withColumn("reading", editions.read_gap(F.col("b"), F.col("a")))


def _lengths(v: Views) -> DataFrame:
    return v.texts.groupBy("article", "lang").agg(F.max(F.length("text")).cast("long").alias("length"))


_LENGTHS = ", le as (select article, lang, max(length(text)) length from texts group by 1, 2)"


@query(_LENGTHS + """, f as (select *, list_position(['en', 'de'], lang) fixed from le), r as (select *, row_number() over (partition by article, fixed is null order by length desc, lang) r from f), k as (select * from r where fixed is not null or (length >= 2000 and r <= 2))
select article, row_number() over (partition by article order by fixed is null, coalesce(fixed, 0), r) place, lang from k qualify place <= 5""")
def select_editions(v: Views) -> DataFrame:
    return editions.select_editions(_lengths(v), ["de"])


@query(_LENGTHS + """, r as (select *, row_number() over (partition by article order by lang <> 'fr', length desc, list_position(['en', 'de', 'fr', 'es'], lang), lang) r from le where length > 0),
c as (select article, list(lang order by r) filter (where r <= case when hf then 3 else 3 end) l, bool_or(lang = 'en') e from (select *, bool_or(lang = 'fr') over (partition by article) hf from r) group by 1)
select article, array_to_string(case when e and not list_contains(l, 'en') then case when len(l) < 3 then list_append(l, 'en') else list_append(l[1:len(l)-1], 'en') end else l end, ',') langs from c""")
def established_langs(v: Views) -> DataFrame:
    return editions.established_langs(_lengths(v), ["en", "de", "fr", "es"], ["fr"]).select("article", F.array_join("langs", ",").alias("langs"))


def _sets(v: Views) -> DataFrame:
    lang = F.regexp_extract("url", r"://[^/]+/([a-z][a-z])/", 1)
    rows = v.table("pages").select(F.pmod("page_id", F.lit(10)).alias("article"), lang.alias("lang"), T.host_of(F.col("url")).alias("domain"))
    return rows.groupBy("article", "lang").agg(F.collect_set(F.when(F.col("domain") != "", F.col("domain"))).alias("domains"))


_HOSTS = r""", ho as (select page_id, page_id % 10 article, regexp_extract(url, '://[^/]+/([a-z][a-z])/', 1) lang, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') domain from pages)"""


@query(_HOSTS + """, s as (select article, lang, coalesce(list(distinct domain) filter (where domain <> ''), []) d from ho group by 1, 2)
select a.article, count(*) pairs, round_even(avg(case when len(list_distinct(list_concat(a.d, b.d))) = 0 then 1.0 else len(list_intersect(a.d, b.d))/len(list_distinct(list_concat(a.d, b.d))) end), 2) jaccard from s a join s b on a.article = b.article and a.lang < b.lang group by 1""")
def citation_jaccard(v: Views) -> DataFrame:
    return editions.citation_jaccard(_sets(v))


@query(_HOSTS + r""", w as (select article, domain, case when ends_with(domain, '.edu') or contains(domain, '.ac.') then 'edu' when regexp_matches(domain, '\.(gov|mil|int|un\.org)$') then 'gov/int' else string_split(domain, '.')[-1] end cls from ho where domain <> '')
select article, 'domain' kind, domain "name", count(*) n from w group by 1, 3 union all select article, 'class', cls, count(*) from w group by 1, 3 union all select page_id % 10, 'cite', case page_id % 3 when 0 then 'web' when 1 then 'journal' else 'other' end, count(*) from pages where url is not null group by 1, 3""")
def source_composition(v: Views) -> DataFrame:
    """Urls as references of a text, each with a citation template."""
    kind = F.element_at(F.array(F.lit("cite web"), F.lit("Cite  Journal"), F.lit("cite map")), (F.pmod("page_id", F.lit(3)) + 1).cast("int"))
    text = F.concat(F.lit("<ref>{{"), kind, F.lit("|url="), "url", F.lit(" }}</ref>"))
    rows = v.table("pages").where("url is not null").select(F.pmod("page_id", F.lit(10)).alias("article"), text.alias("text"))
    return editions.source_composition(rows, "article").where("kind is not null").groupBy("article", "kind", "name").agg(F.sum("n").alias("n"))


@query(_HOSTS + """, c as (select article, case when page_id % 2 = 0 then 'before' else 'after' end side, domain from ho), d as (select article, domain, count(*) filter (where side = 'before') "before", count(*) filter (where side = 'after') "after" from c group by 1, 2)
select *, "after" - "before" delta from d where "after" <> "before" """)
def domain_deltas(v: Views) -> DataFrame:
    side = F.when(F.pmod("page_id", F.lit(2)) == 0, "before").otherwise("after")
    rows = v.table("pages").select(F.pmod("page_id", F.lit(10)).alias("article"), side.alias("side"), T.host_of(F.col("url")).alias("domain"))
    return editions.domain_deltas(rows.groupBy("article", "side", "domain").agg(F.count(F.lit(1)).alias("n")))


@query("""select article, "name", round_even(100.0::double*n/sum(n) over (partition by article), 0)::int percent from (select p_size article, case p_partkey % 4 when 0 then 'journal' when 1 then 'book' when 2 then 'web' else 'other' end "name", count(*) n from part group by 1, 2) where "name" <> 'other' """)
def cite_mix(v: Views) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("journal", "book", "web", "other"))), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    return editions.cite_mix(v.table("part").groupBy(F.col("p_size").alias("article"), name.alias("name")).agg(F.count(F.lit(1)).alias("n")))


_CUT = "replace(replace(replace(substr(text, {}, 30), ' ', '  '), '-', '–'), chr(39), '’')"


@query(f"""select doc_id id, place, case when doc_id % 3 <> 0 then q end quote from (select doc_id, 1 place, {_CUT.format("11")} q from documents union all select doc_id, 2, {_CUT.format("1 + length(text) // 2")} from documents)""")
def ground_evidence(v: Views) -> DataFrame:
    """Two cuttings of each text with other spaces, dashes and quotes, every third text's altered, which grounding takes away."""
    docs = v.table("documents").select(F.col("doc_id").alias("id"), "text")
    cut = lambda at: F.replace(F.replace(F.replace(F.substring("text", at, F.lit(30)), F.lit(" "), F.lit("  ")), F.lit("-"), F.lit("–")), F.lit("'"), F.lit("’"))
    rows = docs.select("id", F.posexplode(F.array(cut(F.lit(11)), cut((1 + F.floor(F.length("text") / 2)).cast("int")))).alias("place", "quote"))
    rows = rows.withColumns({"place": F.col("place") + 1, "quote": F.when(F.col("id") % 3 != 0, F.col("quote")).otherwise(F.concat("quote", F.lit("#§")))})
    return editions.ground_evidence(rows, docs)
