"""Scalar text, date, money and array functions over posting text and postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import terms
from postlens.functions import text as T
from postlens.sources.fixtures import posting_text, postings, table

QUERIES: dict = {}


def _add(name, run, sql=None):
    QUERIES[name] = (run, sql)


def _text(name, make, sql):
    """A query of one derived column over posting text."""
    _add(name, lambda s, d: posting_text(s, d).select("job_id", make(F.col("description")).alias("value")), f"select job_id, {sql} as value from posting_text")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _has(words, c="description"):
    return "(" + " or ".join(f"contains(lower({c}), {_q(w)})" for w in words) + ")"


def _chain(pairs, default=None):
    return "case " + " ".join(f"when {cond} then {_q(v)}" for cond, v in pairs) + (f" else {_q(default)}" if default else "") + " end"


_text("p1_clean_text", T.clean_text, r"nullif(trim(regexp_replace(description, '\s+', ' ', 'g')), '')")
_text("p2_normalize_text", T.normalize_text, r"trim(regexp_replace(regexp_replace(lower(description), '[^a-z0-9 \t\n\r]', ' ', 'g'), '\s+', ' ', 'g'))")
_add(
    "p3_strip_html", lambda s, d: table(s, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("value")),
    r"""select page_id, case when contains(html, '<') and contains(html, '>') then trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) else html end as value from pages""",
)
_text("p4_real_description", T.is_real_description, f"coalesce(lower(trim(description)) not in ({', '.join(map(_q, terms.PLACEHOLDER_TEXTS))}) and length(trim(description)) >= 40, false)")
_add(
    "p5_fill_description", lambda s, d: table(s, d, "documents").select("doc_id", T.fill_description(F.when(F.col("doc_id") % 5 != 0, F.col("text"))).alias("value")),
    "select doc_id, case when doc_id % 5 = 0 or coalesce(trim(text), '') = '' then 'No description' else text end as value from documents",
)
_add(
    "p6_stable_id", lambda s, d: postings(s, d).select("job_id", T.stable_id(F.col("source"), F.col("job_id").cast("string")).alias("value")),
    "select job_id, substr(sha256(source || '|' || cast(job_id as varchar)), 1, 16) as value from postings",
)
_add(
    "p7_dedup_keys",
    lambda s, d: postings(s, d).select("job_id", T.dedup_key(F.col("tech_category"), F.col("company"), F.col("country")).alias("key"), T.fingerprint(F.col("tech_category"), F.col("company"), F.col("country")).alias("fingerprint")),
    r"""select job_id, md5(lower(trim(tech_category)) || '|' || lower(trim(company)) || '|' || lower(trim(country))) as key,
  substr(sha256(array_to_string([trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9 \t\n\r]', ' ', 'g'), '\s+', ' ', 'g')) for x in [tech_category, company, country]], '|')), 1, 20) as fingerprint from postings""",
)
_add(
    "p8_normalize_url", lambda s, d: table(s, d, "pages").select("page_id", T.normalize_url(F.col("url")).alias("url"), T.last_path_segment(F.col("url")).alias("source_id")),
    r"select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') as url, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]+)$', 1) as source_id from pages",
)
_NAMES = ["that", "pour", "und", "para"]
_text("p9_guess_country", lambda c: T.first_contained(c, _NAMES), _chain([(_has([n]), n) for n in _NAMES]))
_WRITTEN_COUNTRY = ["Kenya", " nigeria", "ZA", "ken", None, "Worldwide", "NATION_4", "cape verde", "LAG", "côte d'ivoire", "BWA"]


def _countries(s, d):
    """Countries as people write them."""
    k = (F.col("job_id") % (len(_WRITTEN_COUNTRY) + 1)).cast("int")
    return postings(s, d).select("job_id", F.when(k < len(_WRITTEN_COUNTRY), F.element_at(F.array(*map(F.lit, _WRITTEN_COUNTRY)), F.least(k, F.lit(len(_WRITTEN_COUNTRY) - 1)) + 1)).otherwise(F.col("country")).alias("country"))


_COUNTRY_SQL = f"(select job_id, case when job_id % {len(_WRITTEN_COUNTRY) + 1} < {len(_WRITTEN_COUNTRY)} then list_extract([{', '.join('null' if x is None else _q(x) for x in _WRITTEN_COUNTRY)}], cast(job_id % {len(_WRITTEN_COUNTRY) + 1} + 1 as int)) else country end as country from postings)"
_SPELT = "(select * from (values " + ", ".join(f"({_q(k.lower())}, {_q(v)})" for k, v in {**{n: n for n, _, _ in terms.COUNTRIES}, **terms.COUNTRY_SPELLINGS}.items()) + ") as spelt(k, v))"
_add("p10_normalize_country", lambda s, d: _countries(s, d).select("job_id", T.normalize_country(F.col("country")).alias("value")), f"select job_id, case when country is null then 'Unknown' else coalesce(v, 'Global Remote') end as value from {_COUNTRY_SQL} left join {_SPELT} on lower(trim(country)) = k")
_ISO = "(select * from (values " + ", ".join(f"({_q(n)}, {_q(a)}, {_q(b)})" for n, a, b in terms.COUNTRIES) + ") as iso(n, a, b))"
_add("p11_iso_match", lambda s, d: _countries(s, d).select("job_id", T.match_country(F.col("country")).alias("value")), f"select job_id, n as value from {_COUNTRY_SQL} left join {_ISO} on upper(trim(country)) in (a, b) or array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(trim(country), ' ')], ' ') = n")
_AS_TEXT = "case job_id % 4 when 0 then strftime(date_posted, '%Y-%m-%d') when 1 then strftime(date_posted, '%d/%m/%Y') when 2 then 'soon' end"


def _dates(s, d):
    k, t = F.col("job_id") % 4, F.col("date_posted")
    return postings(s, d).select("job_id", F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "dd/MM/yyyy")).when(k == 2, "soon").alias("written"))


_add("p12_normalize_date", lambda s, d: _dates(s, d).select("job_id", F.date_format(T.parse_date(F.col("written")), "yyyy-MM-dd").alias("value")), "select job_id, case when job_id % 4 < 2 then strftime(date_posted, '%Y-%m-%d') end as value from postings")
_add("p13_parse_deadline", lambda s, d: _dates(s, d).select("job_id", T.parse_date(F.substring("written", 1, 10)).cast("string").alias("value")), "select job_id, case when job_id % 4 < 2 then cast(date_posted as varchar) end as value from postings")


def _late():
    return F.when(F.col("job_id") % 4 == 3, F.concat(F.date_format("date_posted", "yyyy-MM-dd"), F.lit("T23:30:00-03:00")))


_add(
    "p14_day_first_date", lambda s, d: _dates(s, d).join(postings(s, d).select("job_id", _late().alias("zoned")), "job_id").select("job_id", T.parse_date(F.coalesce("written", "zoned"), ("dd/MM/yyyy", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ssXXX")).cast("string").alias("value")),
    "select job_id, case when job_id % 4 < 2 then cast(date_posted as varchar) when job_id % 4 = 3 then cast(cast(date_posted + 1 as date) as varchar) end as value from postings",
)
_text("p15_guess_work_mode", T.guess_work_mode, _chain([(_has(["hybrid"]), "hybrid"), (_has(["remote", "work from home", "wfh"]), "remote"), (_has(["on-site", "onsite", "on site"]), "onsite")], "unknown"))
_text("p16_extract_work_mode", T.extract_work_mode, _chain([(_has(["fully remote", "work from home", "remote"]), "Remote"), (_has(["hybrid"]), "Hybrid"), (_has(["on-site", "on site", "onsite", "in-office", "in office"]), "On-Site")]))
_add(
    "p17_work_mode_of_tags",
    lambda s, d: postings(s, d).select("job_id", F.array("work_mode", F.lower("source")).alias("tags")).select(
        "job_id", F.when(F.array_contains("tags", "remote"), "remote").when(F.array_contains("tags", "hybrid"), "hybrid").when(F.arrays_overlap("tags", F.array(F.lit("onsite"), F.lit("office"))), "onsite").alias("value")),
    "select job_id, work_mode as value from postings",
)
_MODE = ["On-Site", " REMOTE ", "office", None]


def _mode_of():
    return F.element_at(F.array(*map(F.lit, _MODE)), (F.col("job_id") % 4 + 1).cast("int"))


_add(
    "p17_work_mode_or_text", lambda s, d: posting_text(s, d).select("job_id", T.normalize_work_mode(_mode_of(), F.col("description")).alias("value")),
    f"select job_id, case job_id % 4 when 0 then 'onsite' when 1 then 'remote' else {_chain([(_has(['hybrid']), 'hybrid'), (_has(['remote', 'work from home', 'wfh']), 'remote'), (_has(['on-site', 'onsite', 'on site']), 'onsite')], 'unknown')} end as value from posting_text",
)
_text("p18_remote_scope", T.guess_remote_scope, f"case when {_has(['remote'])} then {_chain([(_has(['worldwide', 'global', 'anywhere']), 'Global'), (_has(['africa']), 'Africa-wide')], 'Country-only')} end")
_text("p19_is_tech", lambda c: T.any_contained(c, terms.TECH_KEYWORDS), _has(terms.TECH_KEYWORDS))
_text("p20_tech_category", T.tech_category, _chain([*[(_has(w), k) for k, w in terms.TECH_CATEGORY_MAP.items()], (_has(terms.TECH_KEYWORDS), "Other Tech")]))
_text("p21_guess_currency", T.guess_currency, _chain([(f"regexp_matches(description, {_q('(?i)' + '|'.join(p))})", k) for k, p in terms.CURRENCY_PATTERNS.items()]))
_CUE = r"(?i)(?:\$|€|£|USD|EUR|GBP|KES|NGN|ZAR)\s?([0-9][0-9,]{2,}|[0-9]+k)"
_add(
    "p22_salary_range",
    lambda s, d: posting_text(s, d).select("job_id", T.salary_bounds(F.col("description"))[0].alias("low"), T.salary_bounds(F.col("description"))[1].alias("high")),
    f"""select job_id, list_min(a) as low, list_max(a) as high from (select job_id,
  [cast(regexp_replace(lower(x), '[,k]', '', 'g') as double) * case when lower(x) like '%k' then 1000 else 1 end for x in regexp_extract_all(description, {_q(_CUE)}, 1)] as a from posting_text)""",
)
_VALID = "regexp_matches(replace(x, ',', ''), '^(\\d+\\.?\\d*|\\.\\d+)$')"
_NUMBER = "cast(replace({}, ',', '') as double)"


def _written_pairs(p):
    a, b = (f"regexp_extract_all(description, {_q(p)}, {g})" for g in (1, 2))
    ok = _VALID.replace("(x,", "(z[1],") + " and " + _VALID.replace("(x,", "(z[2],")
    return f"list_transform(list_filter(list_transform(range(1, len({a}) + 1), lambda i: [list_extract({a}, i), list_extract({b}, i)]), lambda z: {ok}), lambda z: [{_NUMBER.format('z[1]')}, {_NUMBER.format('z[2]')}])"


# The lower bound starts anew after every pair whose lower amount is 0 (but the last).
_WRITTEN = f"""(select job_id, currency, singles, list_transform(pairs, lambda z: z[1]) as lows, list_max(list_transform(pairs, lambda z: z[2])) as top from (select job_id,
  list_concat({_written_pairs(terms.SALARY_PATTERNS[0])}, {_written_pairs(terms.SALARY_PATTERNS[1])}) as pairs,
  list_transform(list_filter(regexp_extract_all(description, {_q(terms.SALARY_PATTERNS[2])}, 1), lambda x: {_VALID}), lambda x: {_NUMBER.format('x')}) as singles,
  {_chain([(" or ".join(f"contains(lower(description), {_q(w)})" for w in words), k) for k, words in terms.SALARY_CURRENCIES.items()], "USD")} as currency from posting_text))"""
_add(
    "p22_salary_as_written", lambda s, d: posting_text(s, d).select("job_id", *[c.alias(k) for k, c in zip(("low", "high", "currency"), T.salary_as_written(F.col("description")))]),
    f"""select job_id, case when len(lows) = 0 then singles[1] else least_low end as low, case when len(lows) = 0 then case when len(singles) > 1 then singles[-1] end else coalesce(singles[-1], top) end as high, currency
from (select *, case when lows[-1] = 0 then 0 else list_min(list_slice(lows, coalesce(list_max(list_filter(range(1, len(lows) + 1), lambda i: lows[i] = 0)), 0) + 1, len(lows))) end as least_low from {_WRITTEN})""",
)
_RATE = "case currency when 'EUR' then 1.10::double when 'KES' then 0.0078::double else 1.0::double end"
_add(
    "p23_to_usd", lambda s, d: postings(s, d).select("job_id", F.round(T.to_usd(F.col("salary_min"), F.col("currency")), 1).alias("usd_min"), F.round(T.to_usd(F.col("salary_max"), F.col("currency")), 1).alias("usd_max")),
    f"select job_id, round(salary_min * {_RATE}, 1) as usd_min, round(salary_max * {_RATE}, 1) as usd_max from postings",
)
_BUCKET = "case when years_experience is null or years_experience = 0 then 'Not specified' when years_experience < 1 then '0-1 years' when years_experience < 3 then '1-3 years' when years_experience < 5 then '3-5 years' when years_experience < 10 then '5-10 years' else '10+ years' end"
_add("p24_experience_bucket", lambda s, d: postings(s, d).select("job_id", T.experience_bucket(F.col("years_experience")).alias("value")), f"select job_id, {_BUCKET} as value from postings")
_add("p25_seniority_rank", lambda s, d: postings(s, d).select("job_id", T.seniority_rank(F.col("seniority")).alias("value")), "select job_id, case seniority when 'Intern' then 0 when 'Entry Level' then 1 when 'Mid-Level' then 2 when 'Senior' then 3 when 'Lead' then 4 when 'Executive' then 5 else 2 end as value from postings")


def _modes():
    return F.element_at(F.array(*map(F.lit, ["remote", "hybrid", "onsite"])), (F.col("job_id") % 3 + 1).cast("int"))


_add(
    "p26_flags",
    lambda s, d: posting_text(s, d).withColumn("mode", _modes()).join(postings(s, d).select("job_id", "salary_min", "salary_max", "currency"), "job_id").select(
        "job_id", (F.lower("mode") == "remote").alias("is_remote"), T.is_pan_african(F.col("mode"), F.col("description")).alias("is_pan_african"), (F.size(T.labels(F.col("description"), terms.CERTIFICATIONS)) > 0).alias("requires_certification"),
        F.coalesce((T.to_usd(F.col("salary_min"), F.col("currency")) > 100000) | (T.to_usd(F.col("salary_max"), F.col("currency")) > 100000), F.lit(False)).alias("is_high_salary"), F.coalesce(F.col("salary_min") > 0, F.lit(False)).alias("has_salary")),
    f"""select job_id, job_id % 3 = 0 as is_remote, job_id % 3 = 0 or {_has(terms.PAN_AFRICAN_WORDS)} as is_pan_african, {_has(terms.CERTIFICATIONS)} as requires_certification,
  coalesce(salary_min * {_RATE} > 100000 or salary_max * {_RATE} > 100000, false) as is_high_salary, coalesce(salary_min > 0, false) as has_salary from posting_text join (select job_id, salary_min, salary_max, currency from postings) using (job_id)""",
)
_add(
    "p27_json_map", lambda s, d: table(s, d, "events").select("event_id", F.element_at(F.from_json("props", "map<string,int>"), "k").alias("k"), F.coalesce(F.cardinality(F.from_json("props", "map<string,int>")), F.lit(0)).alias("richness")),
    "select event_id, cast(json_extract(props, '$.k') as int) as k, coalesce(len(json_keys(props)), 0)::int as richness from events",
)
def _years(patterns, low, high):
    found = "flatten([" + ", ".join(f"regexp_extract_all(lower(description), {_q(p)}, 1)" for p in patterns) + "])"
    return f"coalesce(list_max(list_filter([try_cast(x as int) for x in {found}], lambda x: x between {low} and {high})), 0)"


_text("p28_years_experience", T.years_experience, _years(terms.EXPERIENCE_PATTERNS, 0, 2**31 - 1))
_text("p28_years_of_service", lambda c: T.years_experience(c, terms.SERVICE_EXPERIENCE_PATTERNS, 1, 40), _years(terms.SERVICE_EXPERIENCE_PATTERNS, 1, 40))


def _labels(words):
    return "list_sort(list_distinct(list_filter([" + ", ".join(f"case when {_has([k])} then {_q(v)} end" for k, v in words.items()) + "], lambda x: x is not null)))"


def _joined(name, words):
    _text(name, lambda c: F.array_join(T.labels(c, words), ";"), f"array_to_string({_labels(words)}, ';')")


_text("p29_education", lambda c: F.array_join(T.matching_labels(c, terms.EDUCATION), ";"), "array_to_string(list_sort(list_filter([" + ", ".join(f"case when regexp_matches(lower(description), {_q(p)}) then {_q(k)} end" for k, p in terms.EDUCATION.items()) + "], lambda x: x is not null)), ';')")
_joined("p29_education_of_service", terms.SERVICE_EDUCATION)
_joined("p30_certifications_of_service", {k: k for k in terms.SERVICE_CERTIFICATIONS})
_joined("p30_certifications", terms.CERTIFICATIONS)
_SENIOR = [(_has([k]), v) for k, v in terms.SENIORITY_KEYWORDS.items()]
_TITLES = ["Senior Engineer", "Data Analyst", "Junior Developer", "Head of Sales"]


def _title():
    return F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("job_id") % 4 + 1).cast("int"))


_TITLE_SQL = f"list_extract([{', '.join(map(_q, _TITLES))}], cast(job_id % 4 + 1 as int))"
_add("p31_seniority", lambda s, d: posting_text(s, d).select("job_id", T.seniority(_title(), F.col("description")).alias("value")), f"select job_id, case job_id % 4 when 0 then 'Senior' when 2 then 'Entry Level' else {_chain(_SENIOR, 'Mid-Level')} end as value from posting_text")
_text("p32_seniority_or_unspecified", lambda c: F.coalesce(T.by_keyword(c, terms.SENIORITY_KEYWORDS), F.lit("Unspecified")), _chain(_SENIOR, "Unspecified"))
_add("p33_seniority_from_years", lambda s, d: postings(s, d).select("job_id", T.seniority_from_years(F.col("years_experience")).alias("value")), "select job_id, case when years_experience = 0 then 'Intern' when years_experience < 2 then 'Entry Level' when years_experience < 5 then 'Mid-Level' when years_experience < 10 then 'Senior' when years_experience < 15 then 'Lead' else 'Executive' end as value from postings")
_text("p34_employment_type", lambda c: T.by_keyword(c, terms.EMPLOYMENT_KEYWORDS), _chain([(_has([k]), v) for k, v in terms.EMPLOYMENT_KEYWORDS.items()]))
_REQUIRED = "flatten([" + ", ".join(f"regexp_extract_all(lower(description), {_q(p)}, 1)" for p in terms.REQUIREMENT_PATTERNS) + "])"
_text("p35_key_requirements", lambda c: F.array_join(T.requirements(c), "|"), f"array_to_string(list_sort(list_distinct(list_slice(list_filter([regexp_replace(x, '^\\s+|\\s+$', '', 'g') for x in {_REQUIRED}], lambda x: length(x) > 10 and length(x) < 200), 1, 10))), '|')")
_text("p36_remote_eligible", lambda c: T.any_contained(c, terms.REMOTE_KEYWORDS), _has(terms.REMOTE_KEYWORDS))
_add(
    "p37_canonical_skills", lambda s, d: postings(s, d).select("job_id", F.array_join(T.canonical_skills(F.array(F.concat(F.lit(" "), F.col("source")), F.when(F.col("job_id") % 2 == 0, "K8s").otherwise("Golang"))), ",").alias("value")),
    "select job_id, array_to_string(list_sort(list_distinct([lower(source), case when job_id % 2 = 0 then 'kubernetes' else 'go' end])), ',') as value from postings",
)
_add(
    "p39_title_split",
    lambda s, d: table(s, d, "part").select("p_partkey", F.split(F.concat("p_brand", F.lit(": "), "p_name"), ": ", 2).alias("x"), F.concat(F.lit("Company: "), "p_brand", F.lit("  Location:\n"), "p_type", F.lit(" Posted: 2024")).alias("page")).select(
        "p_partkey", F.col("x")[0].alias("company"), F.col("x")[1].alias("title"), T.labelled_value(F.col("page"), "Location", ["Company", "Posted"]).alias("location"), T.labelled_value(F.col("page"), "Posted", ["Company", "Location"]).alias("posted")),
    "select p_partkey, p_brand as company, p_name as title, p_type as location, '2024' as posted from part",
)
_add(
    "p40_links", lambda s, d: table(s, d, "pages").select("page_id", F.array_join(T.links(F.col("html"), F.col("url")), " ").alias("links")),
    """select page_id, coalesce(array_to_string(list_sort(list_distinct([case when starts_with(x, '/') then regexp_extract(url, '^(https?://[^/?#]+)', 1) || x else x end
  for x in regexp_extract_all(html, 'href="([^"]*)"', 1) if regexp_matches(x, '^(/|https?://)')])), ' '), '') as links from pages""",
)
_add(
    "p41_section", lambda s, d: table(s, d, "pages").select("page_id", T.section(F.col("html"), "</h1>").alias("value")),
    r"""select page_id, substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace('<p>' || regexp_extract(html, '(?is)</h1>(.*?)(?:<h[1-6][ >]|</body>|$)', 1), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')), 1, 10000) as value from pages""",
)


def _p42(s, d):
    q = F.trim("text")
    error = F.when(F.col("text").isNull() | (q == ""), "empty").when(F.length(q) < 2, "too short").when(~q.rlike("[A-Za-z0-9]"), "no letters or digits")
    return table(s, d, "conversations").select("conv_id", "turn", error.alias("error"), F.substring(q, 1, 500).alias("query"), F.least(F.greatest(F.col("turn").cast("int"), F.lit(1)), F.lit(50)).alias("k"))


_add("p42_validate_query", _p42, "select conv_id, turn, case when text is null or trim(text) = '' then 'empty' when length(trim(text)) < 2 then 'too short' when not regexp_matches(trim(text), '[A-Za-z0-9]') then 'no letters or digits' end as error, substr(trim(text), 1, 500) as query, least(greatest(cast(turn as int), 1), 50) as k from conversations")
_add(
    "p43_title_tokens", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(T.title_tokens(F.col("p_name"), ["small", "large"], {"ring": "band"}), " ").alias("value")),
    "select p_partkey, array_to_string([case when w = 'ring' then 'band' else w end for w in string_split(p_name, ' ') if w not in ('small', 'large')], ' ') as value from part",
)


def _p43_role(s, d):
    """Does the title of the part before name the same role?"""
    p = table(s, d, "part").select("p_partkey", T.title_tokens(F.col("p_name"), ["small", "large", "dim"], {"ring": "band of metal"}).alias("title"))
    before = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("title").alias("role"))
    return p.join(before, "p_partkey").select("p_partkey", T.role_matches(F.col("role"), F.col("title")).alias("same"))


_TOKENS = "(select p_partkey, list_distinct(flatten([case when w = 'ring' then ['band', 'of', 'metal'] else [w] end for w in string_split(p_name, ' ') if w not in ('small', 'large', 'dim')])) as t from part)"
_add("p43_role_match", _p43_role, f"select a.p_partkey, len(a.t) > 0 and len(b.t) > 0 and (list_has_all(a.t, b.t) or list_has_all(b.t, a.t)) as same from {_TOKENS} a join {_TOKENS} b on b.p_partkey = a.p_partkey - 1")
