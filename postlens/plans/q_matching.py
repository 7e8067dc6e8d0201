"""Candidate matching, recommendation and derived scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postlens.functions import terms
from postlens.functions import text as T
from postlens.operators import recommend as R
from postlens.operators import skills as K
from postlens.plans import q_text
from postlens.plans.q_skills import _EXTRACT, TAXONOMY
from postlens.sources.files import save
from postlens.sources.fixtures import candidates, posting_skills, posting_text, postings, table

QUERIES: dict = {}


def _add(name, run, sql=None):
    QUERIES[name] = (run, sql)


def _as_of(s, d):
    """The day of the newest posting: deadlines are counted from it."""
    return table(s, d, "orders").agg(F.to_date(F.max("o_orderdate"))).first()[0]


def _jobs(s, d):
    """Postings with required skills (asked for somewhere without being optional) and preferred ones, and a deadline."""
    one = posting_skills(s, d, True).groupBy("job_id", "skill").agg(F.min("is_preferred").alias("optional"))
    sets = one.groupBy("job_id").agg(F.array_sort(F.collect_list(F.when(~F.col("optional"), F.col("skill")))).alias("required"), F.array_sort(F.collect_list(F.when(F.col("optional"), F.col("skill")))).alias("preferred"))
    none = F.array().cast("array<string>")
    out = postings(s, d).join(sets, "job_id", "left").withColumns({"required": F.coalesce("required", none), "preferred": F.coalesce("preferred", none)})
    return out.withColumns({"deadline": F.date_add("date_posted", (F.col("job_id") % 30).cast("int")), "title": F.concat_ws(" ", "seniority", "source")})


def _who(s, d):
    """A row for each candidate."""
    mode = F.element_at(F.array(*map(F.lit, ["remote", "hybrid", "onsite"])), (F.col("candidate_id") % 3 + 1).cast("int"))
    one = candidates(s, d).groupBy("candidate_id").agg(F.array_sort(F.collect_set("skill")).alias("skills"), F.max("years").alias("years"), F.max("location").alias("location"))
    return one.withColumns({"locations": F.array("location"), "modes": F.array(mode)})


_JOBS = """(select p.*, coalesce(required, []) as required, coalesce(preferred, []) as preferred, cast(date_posted + cast(p.job_id % 30 as int) as date) as deadline, seniority || ' ' || source as title
  from postings p left join (select job_id, coalesce(list(skill order by skill) filter (where not optional), []) as required, coalesce(list(skill order by skill) filter (where optional), []) as preferred
    from (select job_id, skill, bool_and(is_preferred) as optional from posting_skills group by 1, 2) group by 1) using (job_id))"""
_WHO = "(select candidate_id, list(distinct skill order by skill) as skills, max(years) as years, max(location) as location, list_extract(['remote', 'hybrid', 'onsite'], cast(candidate_id % 3 + 1 as int)) as mode from candidates group by 1)"
_DAY = "(select max(cast(o_orderdate as date)) from orders)"
# Every posting for every candidate: fine for a check on small tables.
_PAIRS = f"""(select *, len(list_intersect(required, skills)) as m, len(required) as n, len(list_intersect(preferred, skills)) as mp, len(preferred) as np,
  greatest(years_experience - years, 0) as gap, cast(deadline - {_DAY} as int) as days from {_JOBS} j, {_WHO} w)"""
_PARTS = f"""(select *, case when n > 0 then m::double / n end as c1, case when np > 0 then mp::double / np end as c2, case when years_experience > 0 then least(1.0::double, years::double / years_experience) end as c3,
  ((lower(country) = lower(location))::int + (work_mode = mode)::int)::double / 2 as c4, days between 0 and 7 as urgent from {_PAIRS})"""
_S = f"""(select *, round((coalesce(c1 * 0.65::double, 0) + coalesce(c2 * 0.15::double, 0) + coalesce(c3 * 0.15::double, 0) + c4 * 0.05::double)
  / ((case when n > 0 then 0.65::double else 0 end) + (case when np > 0 then 0.15::double else 0 end) + (case when years_experience > 0 then 0.15::double else 0 end) + 0.05::double), 6) as score from {_PARTS})"""
_ORDER = "partition by candidate_id order by score desc, gap, urgent desc, job_id"
_T = f"(select * from (select *, cast(row_number() over ({_ORDER}) as int) as rank from {_S}) where rank <= 10)"


def _top(s, d, k=10, who=None):
    return R.top_jobs(_who(s, d) if who is None else who, _jobs(s, d), _as_of(s, d), k)


def _full(s, d, k=10, who=None):
    """The best ``k`` with their reasons; candidates and what is read of the postings are worked out once, for the search and the reasons."""
    who = save(_who(s, d) if who is None else who, "who")
    jobs = save(_jobs(s, d).select("job_id", "title", "country", "work_mode", "years_experience", "deadline", "required", "preferred"), "jobs")
    day = _as_of(s, d)
    return R.explained(R.top_jobs(who, jobs, day, k), who, jobs, day)


def _newcomers(s, d):
    """The same candidates before they had learnt much: two skills, or none for every other one. Their best postings leave gaps."""
    return _who(s, d).withColumn("skills", F.slice("skills", F.lit(1), (F.col("candidate_id") % 2 * 2).cast("int")))


_FEW = f"(select * replace (list_slice(skills, 1, candidate_id % 2 * 2) as skills) from {_WHO})"


_add("r1_overlap", lambda s, d: R.overlaps(_who(s, d), _jobs(s, d)), f"select candidate_id, m as matched, n as size, count(*) as n from {_PAIRS} where m > 0 group by 1, 2, 3")
_COMPONENTS = ["required_skills", "preferred_skills", "experience", "location_work_mode"]
_add("r2_hybrid_score", lambda s, d: _full(s, d).select("candidate_id", "job_id", "score", *[F.round(c, 6).alias(c) for c in _COMPONENTS]), f"select candidate_id, job_id, score, round(c1, 6) as required_skills, round(c2, 6) as preferred_skills, round(c3, 6) as experience, round(c4, 6) as location_work_mode from {_T}")
_add("r3_location_component", lambda s, d: _full(s, d).groupBy("candidate_id", "location_work_mode").agg(F.count("*").alias("jobs")), f"select candidate_id, c4 as location_work_mode, count(*) as jobs from {_T} group by 1, 2")
_REASONS = """concat_ws(' | ', 'Matches ' || m || ' of ' || n || ' required skills.', case when np > 0 then 'Matches ' || mp || ' of ' || np || ' preferred skills.' end,
  case when m < n then 'Build: ' || array_to_string(list_slice(list_filter(required, lambda x: not list_contains(skills, x)), 1, 4), ', ') || '.' end,
  case when gap > 0 then 'Role asks for ' || gap || ' more year(s) of experience.' end,
  case when urgent then 'Deadline is in ' || days || ' day(s); prioritise application and interview practice.' end)"""
_add("r4_gap_and_urgency", lambda s, d: _full(s, d).select("candidate_id", "job_id", "gap", "days_to_deadline", "urgent", F.array_join("reasons", " | ").alias("reasons")), f"select candidate_id, job_id, gap, days as days_to_deadline, urgent, {_REASONS} as reasons from {_T}")
_add("r5_top_jobs", lambda s, d: _top(s, d).select("candidate_id", "job_id", "score", "rank"), f"select candidate_id, job_id, score, rank from {_T}")
_GAPS = f"""(select *, cast(row_number() over (partition by candidate_id order by priority desc, skill) as int) as rank from (
  select candidate_id, skill, sum(cast(round(score * 1000000) as bigint) * case when urgent then 5 else 4 end)::double / 4000000 as priority
  from (select candidate_id, score, urgent, unnest(list_filter(required, lambda x: not list_contains(skills, x))) as skill from {_T} where score > 0) group by 1, 2))"""
_G = f"(select * from {_GAPS} where rank <= 5)"
_COURSES = "(select lower(p_brand) as skill, min(p_name) as title, 'Part school' as provider, 'https://example.org/learn/' || min(p_partkey) as url from part where p_size = 50 group by 1)"


def _courses(s, d):
    return table(s, d, "part").where("p_size = 50").groupBy(F.lower("p_brand").alias("skill")).agg(F.min("p_name").alias("title"), F.lit("Part school").alias("provider"), F.concat(F.lit("https://example.org/learn/"), F.min("p_partkey").cast("string")).alias("url"))


_COURSE_SQL = "coalesce(title, 'Learn ' || skill) as title, coalesce(provider, 'Coursera') as provider, coalesce(url, 'https://www.coursera.org/search?query=' || replace(skill, '#', '%23')) as url"
_add("r6_gap_priorities", lambda s, d: R.with_courses(R.gaps(_full(s, d)), _courses(s, d)), f"select candidate_id, skill, priority, rank, {_COURSE_SQL} from {_G} left join {_COURSES} using (skill)")
# On these tables the best ten leave no gaps: enough postings ask for nothing that a candidate lacks. The best 200 do.
_add("r6_gaps_of_newcomers", lambda s, d: R.with_courses(R.gaps(_full(s, d, 200, _newcomers(s, d))), _courses(s, d)), QUERIES["r6_gap_priorities"][1].replace(_WHO, _FEW).replace("rank <= 10", "rank <= 200"))
_MARKET = "(select skill, cast(row_number() over (order by count(*) desc, skill) as int) as place from posting_skills group by 1 qualify place <= 50)"
_LACK = f"(select candidate_id, m.skill, cast(row_number() over (partition by candidate_id order by place) as int) as rank from {_WHO} w, {_MARKET} m where not list_contains(skills, m.skill) qualify rank <= 5)"


def _r7(s, d):
    """Candidates whose best posting lacks nothing get the most asked skills that they do not have."""
    who = save(_who(s, d), "who")
    with_gaps = R.gaps(_full(s, d, 1, who)).select("candidate_id").distinct()
    fallback = R.missing_market_skills(who.join(with_gaps, "candidate_id", "left_anti"), posting_skills(s, d, True))
    return R.with_courses(fallback, _courses(s, d)).select("candidate_id", "skill", "rank", "title")


_add("r7_fallback_courses", _r7, f"select candidate_id, skill, rank, coalesce(title, 'Learn ' || skill) as title from {_LACK} left join {_COURSES} using (skill) where candidate_id not in (select candidate_id from {_T} where rank = 1 and score > 0 and m < n)")
_KINDS = "(select lower(p_brand) as skill, max(p_size) = 50 as design, min(split_part(p_type, ' ', 1)) filter (where p_size < 10) as kind from part group by 1)"


def _kinds(s, d):
    return table(s, d, "part").groupBy(F.lower("p_brand").alias("skill")).agg((F.max("p_size") == 50).alias("design"), F.min(F.when(F.col("p_size") < 10, F.split("p_type", " ")[0])).alias("kind"))




def _r8(s, d):
    who = save(_who(s, d), "who")
    return R.practice(who, _full(s, d, who=who), _kinds(s, d))


_add("r8_practice", _r8, f"""select candidate_id, place, skill, case when design then 'system design' else coalesce(kind, 'behavioural') end as kind from (
  select candidate_id, skill, cast(row_number() over (partition by candidate_id order by skill) as int) as place from (select distinct candidate_id, skill from candidates)) left join {_KINDS} using (skill) where place <= 5""")
_add("r9_priority_label", lambda s, d: _top(s, d).groupBy(R.label(F.col("score")).alias("label")).agg(F.count("*").alias("n")), f"select case when score >= 0.6 then 'HIGH' when score >= 0.3 then 'MEDIUM' else 'LOW' end as label, count(*) as n from {_T} group by 1")
_add("r10_profiles", lambda s, d: _who(s, d).select("candidate_id", "years", F.array_join("skills", ",").alias("skills"), "location", F.col("modes")[0].alias("mode")), f"select candidate_id, years, array_to_string(skills, ',') as skills, location, mode from {_WHO}")

_CV_ROLES = ["intern", "junior", "mid-level", "senior", "lead", "manager"]


def _cv(s, d):
    """What a CV says: skills, years, education (three of four), certificates (0 to 4) and the level of the present role."""
    key = F.col("candidate_id")
    return _who(s, d).withColumns({
        "k": F.size("skills"), "education": F.when(key % 4 != 0, F.array(F.lit("Bachelor's Degree"))).otherwise(F.array().cast("array<string>")),
        "certificates": (key % 5).cast("int"), "level": (key % 6).cast("int"),
    })


_CV = f"(select *, len(skills) as k, candidate_id % 4 <> 0 as educated, cast(candidate_id % 5 as int) as certificates, cast(candidate_id % 6 as int) as level from {_WHO})"


def _r12(s, d):
    # 40 for ten skills, 25 for eight years, 20 for education, 15 for three certificates; halves to even.
    part = F.least("k", F.lit(10)) / 10 * 40 + F.least("years", F.lit(8)) * 25 / 8 + F.when(F.size("education") > 0, 20).otherwise(0) + F.least("certificates", F.lit(3)) * 5
    return _cv(s, d).select("candidate_id", F.bround(part, 0).cast("int").alias("score"))


_add("r12_cv_score", _r12, f"select candidate_id, cast(round_even(least(k, 10) * 4 + least(years, 8) * 25::double / 8 + case when educated then 20 else 0 end + least(certificates, 3) * 5, 0) as int) as score from {_CV}")


def _r13(s, d):
    text = lambda c: F.col(c).cast("string")
    strong = F.array_compact(F.array(
        F.when(F.col("k") >= 8, F.concat(F.lit("Broad technical skill set ("), text("k"), F.lit(" skills detected)."))),
        F.when(F.col("years") >= 4, F.concat(text("years"), F.lit("+ years of stated experience."))),
        F.when(F.col("certificates") > 0, F.concat(F.lit("Holds "), text("certificates"), F.lit(" relevant certification(s)."))),
        F.when(F.size("education") > 0, F.concat(F.lit("Education credential detected: "), F.array_join("education", ", "), F.lit("."))),
    ))
    weak = F.array_compact(F.array(
        F.when(F.col("k") <= 2, "Very few technical skills detected in the CV text."), F.when(F.col("years") == 0, "No years of experience explicitly stated."),
        F.when(F.col("certificates") == 0, "No certifications detected."), F.when(F.size("education") == 0, "No formal education credential detected in the CV text."),
    ))
    return _cv(s, d).select("candidate_id", F.array_join(strong, " ").alias("strengths"), F.array_join(weak, " ").alias("weaknesses"), (F.col("k") <= 2).alias("non_tech"))


_add("r13_strengths", _r13, f"""select candidate_id, concat_ws(' ', case when k >= 8 then 'Broad technical skill set (' || k || ' skills detected).' end, case when years >= 4 then years || '+ years of stated experience.' end,
  case when certificates > 0 then 'Holds ' || certificates || ' relevant certification(s).' end, case when educated then 'Education credential detected: Bachelor''s Degree.' end) as strengths,
  concat_ws(' ', case when k <= 2 then 'Very few technical skills detected in the CV text.' end, case when years = 0 then 'No years of experience explicitly stated.' end,
  case when certificates = 0 then 'No certifications detected.' end, case when not educated then 'No formal education credential detected in the CV text.' end) as weaknesses, k <= 2 as non_tech from {_CV}""")
_add("r14_missing_market_skills", lambda s, d: R.missing_market_skills(_who(s, d), posting_skills(s, d)), f"select candidate_id, skill, rank from {_LACK}")


def _r15(s, d):
    job_rank = T.title_rank(F.col("title"))
    cv_rank = F.element_at(F.array(*map(F.lit, [0, 0, 1, 2, 3, 4])), F.col("level") + 1)
    both = _full(s, d).drop("skills", "years").join(_cv(s, d).select("candidate_id", "k", "years", "education", "certificates", "level"), "candidate_id")
    m, n = F.size("matched"), F.size("required")
    gap = F.abs(cv_rank - job_rank)
    both = both.withColumns({
        "keywords": F.when(n > 0, F.floor((200 * m + n) / (2 * n))).otherwise(70).cast("int"),
        "seniority_match": F.when(gap.isNull(), 75).when(gap == 0, 100).when(gap == 1, 60).otherwise(20),
        "education_match": F.when(F.size("education") > 0, 100).otherwise(0),
        "profile": F.floor((F.least(F.lit(200), F.col("k") * 25) + 4 * (F.least(F.lit(30), F.col("years") * 10) + F.when(F.col("certificates") > 0, 20).otherwise(0)) + 2) / 4).cast("int"),
    })
    score = F.floor((55 * F.col("keywords") + 15 * F.col("seniority_match") + 10 * F.col("education_match") + 20 * F.col("profile") + 50) / 100).cast("int")
    status = lambda c, high, low: F.when(c >= high, "pass").when(c >= low, "warn").otherwise("fail")
    both = both.withColumns({
        "ats": score, "keyword_status": F.when(n == 0, "warn").otherwise(status(F.col("keywords"), 70, 40)), "seniority_status": F.when(gap.isNull(), "warn").otherwise(status(-gap, 0, -1)),
        "education_status": status(F.col("education_match"), 100, 100), "profile_status": status(F.col("profile"), 80, 50),
    })
    label = F.when(F.col("ats") >= 80, "ATS ready").when(F.col("ats") >= 60, "Good coverage").when(F.col("ats") >= 40, "Needs tailoring").otherwise("Likely filtered out")
    tips = F.size(F.slice("missing", 1, 5)) + F.when(F.col("education_match") == 0, 1).otherwise(0) + F.when(F.col("profile") < 80, 1).otherwise(0) + F.when(gap >= 2, 1).otherwise(0)
    return both.select("candidate_id", "job_id", "ats", label.alias("label"), "keywords", "seniority_match", "education_match", "profile", "keyword_status", "seniority_status", "education_status", "profile_status", tips.alias("tips"))


_RANK_SQL = r"""case when regexp_matches(lower(title), '(^|[^a-z0-9_])(intern|trainee|graduate|junior|jr|entry)($|[^a-z0-9_])') then 0 when regexp_matches(lower(title), '(^|[^a-z0-9_])(mid|intermediate)($|[^a-z0-9_])') then 1
  when regexp_matches(lower(title), '(^|[^a-z0-9_])(senior|sr)($|[^a-z0-9_])') then 2 when regexp_matches(lower(title), '(^|[^a-z0-9_])(lead|principal|staff|head|chief)($|[^a-z0-9_])') then 3
  when regexp_matches(lower(title), '(^|[^a-z0-9_])(manager|director|vp)($|[^a-z0-9_])') then 4 end"""
_add("r15_ats_score", _r15, f"""select candidate_id, job_id, ats, case when ats >= 80 then 'ATS ready' when ats >= 60 then 'Good coverage' when ats >= 40 then 'Needs tailoring' else 'Likely filtered out' end as label, keywords, seniority_match, education_match, profile,
  case when n = 0 then 'warn' when keywords >= 70 then 'pass' when keywords >= 40 then 'warn' else 'fail' end as keyword_status, case when away is null then 'warn' when away = 0 then 'pass' when away = 1 then 'warn' else 'fail' end as seniority_status,
  case when education_match = 100 then 'pass' else 'fail' end as education_status, case when profile >= 80 then 'pass' when profile >= 50 then 'warn' else 'fail' end as profile_status,
  cast(least(5, n - m) + (education_match = 0)::int + (profile < 80)::int + coalesce(away >= 2, false)::int as int) as tips
from (select *, cast((55 * keywords + 15 * seniority_match + 10 * education_match + 20 * profile + 50) // 100 as int) as ats from (
  select *, cast(case when n > 0 then (200 * m + n) // (2 * n) else 70 end as int) as keywords, case when away is null then 75 when away = 0 then 100 when away = 1 then 60 else 20 end as seniority_match,
    case when educated then 100 else 0 end as education_match, cast((least(200, 25 * k) + 4 * (least(30, 10 * years) + case when certificates > 0 then 20 else 0 end) + 2) // 4 as int) as profile
  from (select t.*, k, educated, certificates, abs(list_extract([0, 0, 1, 2, 3, 4], level + 1) - {_RANK_SQL}) as away from {_T} t join (select candidate_id, k, educated, certificates, level from {_CV}) c on c.candidate_id = t.candidate_id)))""")


def _r16(s, d):
    full = _full(s, d)
    parts = R.market_match(F.size("matched"), F.size("required"), F.col("years"), F.col("country"), F.col("location"), F.col("work_mode") == "remote")
    return full.withColumns(parts).select("candidate_id", "job_id", *parts, R.match_label(F.col("match")).alias("label"))


_MATCH = """(select *, (50 * skill_match + 25 * experience_match + 10 * location_match + 1325) // 100 as match from (
  select *, case when n > 0 then (200 * m + n) // (2 * n) else 0 end as skill_match, least(100, 60 + 6 * years) as experience_match, case when country = location then 100 when work_mode = 'remote' then 90 else 55 end as location_match from {}))"""
_add("r16_market_match", _r16, f"select candidate_id, job_id, cast(skill_match as int) as skill_match, cast(experience_match as int) as experience_match, cast(location_match as int) as location_match, cast(match as int) as match, case when match >= 90 then 'Excellent match' when match >= 75 then 'Strong match' when match >= 55 then 'Good match' when match >= 35 then 'Partial match' else 'Weak match' end as label from {_MATCH.format(_T)}")


def _r17(s, d):
    """Demand is the share of postings, growth the last 30 days against the 30 before."""
    day = _as_of(s, d)
    age = F.datediff(F.lit(day), "date_posted")
    skills = posting_skills(s, d).select("job_id", "skill").distinct().join(postings(s, d).select("job_id", "date_posted"), "job_id")
    stats = skills.groupBy("skill").agg(F.count("*").alias("jobs"), F.count_if(age < 30).alias("last"), F.count_if((age >= 30) & (age < 60)).alias("before"))
    total = postings(s, d).count()
    return R.learning_priority(stats, total)


_add("r17_learning_priority", _r17, f"""select skill, demand, growth, cast((10 * (4 * demand + 2 * greatest(0, least(100, 50 + 2 * growth)) + 2 * ease + 140) + 50) // 100 as int) as score,
  case when 4 * demand + 2 * greatest(0, least(100, 50 + 2 * growth)) + 2 * ease + 140 >= 650 then 'HIGH' when 4 * demand + 2 * greatest(0, least(100, 50 + 2 * growth)) + 2 * ease + 140 >= 450 then 'MEDIUM' else 'LOW' end as priority from (
  select *, case when demand > 35 then 55 else 25 end as ease from (select skill, cast((200 * jobs + t) // (2 * t) as int) as demand, cast(case when b > 0 then floor((200 * (l - b) + b)::double / (2 * b)) else 0 end as int) as growth from (
    select skill, count(*) as jobs, (select count(*) from postings) as t, count(*) filter (where age < 30) as l, count(*) filter (where age >= 30 and age < 60) as b
    from (select skill, {_DAY} - date_posted as age from (select distinct job_id, skill from posting_skills) join postings using (job_id)) group by 1)))""")
_JOBS_WHO = f"(select *, len(list_intersect(required, skills)) as m, len(required) as n from {_JOBS} j, {_WHO} w)"
_NEXT = _MATCH.format(_JOBS_WHO).replace("as match from (", "as match, (50 * ((200 * (m + 1) + n) // (2 * n)) + 25 * experience_match + 10 * location_match + 1325) // 100 as after from (", 1)
_add("r18_unlocks", lambda s, d: R.unlocks(_who(s, d), _jobs(s, d)), f"select candidate_id, skill, count(*) as unlocked from (select candidate_id, unnest(list_filter(required, lambda x: not list_contains(skills, x))) as skill from {_NEXT} where n > 0 and match < 70 and after >= 70) group by 1, 2")


def _r19(s, d):
    return R.career_paths(_who(s, d), _jobs(s, d).select(F.concat_ws(" ", "title", "country").alias("role"), "job_id", "required"))


_ROLE_SKILLS = f"(select distinct title || ' ' || country as role, unnest(required) as skill from {_JOBS})"
_add("r19_career_paths", _r19, f"""select * from (select candidate_id, role, jobs, size - have as missing, have, cast((200 * have + size) // (2 * size) as int) as match, cast(row_number() over (partition by candidate_id order by (200 * have + size) // (2 * size) desc, jobs desc, role) as int) as rank from (
  select candidate_id, role, count(*) as have from (select distinct candidate_id, skill from candidates) join {_ROLE_SKILLS} using (skill) group by 1, 2)
  join (select role, count(*) as size from {_ROLE_SKILLS} group by 1) using (role) join (select title || ' ' || country as role, count(*) as jobs from {_JOBS} group by 1) using (role)) where rank <= 10""")


def _r20(s, d):
    library = table(s, d, "part").select(F.split("p_name", " ")[1].alias("role"), F.lower("p_brand").alias("keyword")).distinct()
    return R.infer_roles(candidates(s, d).select("candidate_id", "skill").distinct(), library)


_add("r20_desired_roles", _r20, """select * from (select candidate_id, role, count(distinct keyword) as score, cast(row_number() over (partition by candidate_id order by count(distinct keyword) desc, role) as int) as rank from (select distinct candidate_id, skill from candidates)
  join (select distinct split_part(p_name, ' ', 2) as role, lower(p_brand) as keyword from part) on skill = keyword or (length(keyword) >= 3 and length(skill) >= 3 and (contains(skill, keyword) or contains(keyword, skill))) group by 1, 2) where rank <= 3""")
_add("j9_level_gap", lambda s, d: (lambda c: c.alias("a").join(c.alias("b"), (F.col("a.category") == F.col("b.category")) & (F.col("b.ordinal") == F.col("a.ordinal") + 1)).select(F.col("a.category").alias("category"), F.col("a.ordinal").alias("ordinal"), (F.col("b.n") - F.col("a.n")).alias("gap")).where("gap > 0"))(posting_skills(s, d).join(postings(s, d).select("job_id", F.array_position(F.array(*map(F.lit, ["Entry Level", "Mid-Level", "Senior", "Lead", "Executive"])), F.col("seniority")).cast("int").alias("ordinal")), "job_id").groupBy("category", "ordinal").agg(F.count("*").alias("n"))), "select * from (with c as (select category, cast(list_position(['Entry Level', 'Mid-Level', 'Senior', 'Lead', 'Executive'], seniority) as int) as ordinal, count(*) as n from posting_skills join postings using (job_id) group by 1, 2) select a.category, a.ordinal, b.n - a.n as gap from c a join c b on a.category = b.category and b.ordinal = a.ordinal + 1 where b.n > a.n)")
_add("w6_rank_of_expected", lambda s, d: _full(s, d).where("country = location").groupBy("candidate_id").agg(F.min("rank").alias("rank")), f"select candidate_id, min(rank) as rank from {_T} where country = location group by 1")
_add("j7_inverted_join", lambda s, d: R.reach(_who(s, d), _jobs(s, d)), f"select job_id, count(*) as candidates, max(m::double / n) as best from {_PAIRS} where m > 0 group by 1")
_add("o5_composite_rank", lambda s, d: _top(s, d).where("rank <= 3").select("candidate_id", "job_id", "rank", "score", "gap", "urgent"), f"select candidate_id, job_id, rank, score, gap, urgent from {_T} where rank <= 3")


def _e3(s, d):
    """A posting in the candidate's own country is what is expected: top-1 accuracy, mean rank, and components known in the top 3."""
    full = _full(s, d)
    known = sum((F.col(c).isNotNull().cast("int") for c in _COMPONENTS), F.lit(0))
    near = F.col("country") == F.col("location")
    one = full.groupBy("candidate_id").agg(F.max(((F.col("rank") == 1) & near).cast("int")).alias("first"), F.min(F.when(near, F.col("rank"))).alias("at"), F.sum(F.when(F.col("rank") <= 3, known)).alias("known"), F.count_if(F.col("rank") <= 3).alias("n"))
    return one.agg(F.count("*").alias("candidates"), F.round(F.avg("first"), 6).alias("top1_accuracy"), F.round(F.avg("at"), 6).alias("mean_rank"), F.round(F.sum("known") / (4 * F.sum("n")), 6).alias("coverage_top3"))


_add("e3_recommender_metrics", _e3, f"""select count(*) as candidates, round(avg(first), 6) as top1_accuracy, round(avg(place), 6) as mean_rank, round(sum(known)::double / (4 * sum(n)), 6) as coverage_top3 from (
  select candidate_id, max((rank = 1 and country = location)::int) as first, min(rank) filter (where country = location) as place,
    sum((c1 is not null)::int + (c2 is not null)::int + (c3 is not null)::int + (c4 is not null)::int) filter (where rank <= 3) as known, count(*) filter (where rank <= 3) as n from {_T} group by 1)""")


_YEAR = "(?:^|[^0-9A-Za-z])((?:19|20)[0-9]{2})(?:$|[^0-9A-Za-z])"
#: First lines that CVs have, put before the texts.
_HEADERS = ["JANE  W. DOE\n", "jane@example.org\n  Kofi   Mensah \n", "\n\nX\nMARY-ANN O'NEIL\n", ""]


def _r11(s, d):
    """Profiles from texts: the name, skills, and years from phrases or from the earliest year named, counted from the newest posting's year."""
    head = F.element_at(F.array(*map(F.lit, _HEADERS)), (F.col("job_id") % len(_HEADERS) + 1).cast("int"))
    t = posting_text(s, d).withColumn("cv", F.concat(head, "description"))
    now = _as_of(s, d).year
    named = F.array_min(F.filter(F.transform(F.regexp_extract_all("cv", F.lit(_YEAR), F.lit(1)), lambda x: x.cast("int")), lambda y: y <= now))
    years = F.least(F.greatest(T.years_experience(F.col("cv")), F.coalesce(F.lit(now) - named, F.lit(0))), F.lit(50))
    skills = F.size(T.canonical_skills(K.skills_in(F.col("cv"), TAXONOMY)))
    return t.select("job_id", T.name_line(F.col("cv")).alias("name"), years.alias("years"), skills.alias("skills"))


_NAME_SQL = r"""(select job_id, coalesce(list_filter(list_transform(list_slice(string_split(cv, chr(10)), 1, 8), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '' and not contains(x, '@') and length(x) between 2 and 70 and len(string_split(x, ' ')) <= 5)[1], 'Candidate') as line from cvs)"""
_CVS = f"cvs as (select job_id, list_extract([{', '.join(q_text._q(h) for h in _HEADERS)}], cast(job_id % {len(_HEADERS)} + 1 as int)) || description as cv from posting_text)"
_ALIASED = "(select * from (values " + ", ".join(f"({q_text._q(k)}, {q_text._q(v)})" for k, v in terms.SKILL_ALIASES.items()) + ") as aliased(k, v))"
_add("r11_profiles_from_text", _r11, f"""select * from (with {_CVS}, y as (select year({_DAY}) as now)
select t.job_id, case when regexp_matches(line, '[A-Z]') and line = upper(line) then array_to_string(list_transform(regexp_extract_all(line, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '') else line end as name,
  cast(least(greatest(p.value, coalesce(now - list_min(list_filter([cast(x as int) for x in regexp_extract_all(cv, '{_YEAR}', 1)], lambda q: q <= now)), 0)), 50) as int) as years, cast(coalesce(k, 0) as int) as skills
from cvs t cross join y join {_NAME_SQL} n on n.job_id = t.job_id join ({q_text.QUERIES['p28_years_experience'][1]}) p on p.job_id = t.job_id
left join (select job_id, count(distinct coalesce(v, skill)) as k from {_EXTRACT} left join {_ALIASED} on k = skill group by 1) f on f.job_id = t.job_id)""")
