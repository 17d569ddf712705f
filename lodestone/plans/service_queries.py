"""Queries on repositories, answers, hints, retrieval and sweeps; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import annotations, answers, chunking, govern, repositories, retrieval, work
from lodestone.plans.registry import FIXTURES, ORACLE_SQL, fixture, query
from lodestone.sources.tables import few, stage, table
from lodestone.streaming import jobs

FIXTURES.update({
    "labels_of": """select r_name as repository_id, c_custkey as ordinal, 'file' as type, concat('file:', cast(c_custkey as string)) as id, concat(c_mktsegment, '-', cast(c_custkey % 500 as string)) as label
        from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey union all select r_name, -1, 'repository', concat('repository:', r_name), r_name from {region}""",
    "hints": """select r_name as repository_id, s_suppkey as question_id, case when s_suppkey % 11 = 0 then 'Repository' when s_suppkey % 7 = 0 then 'g-' when s_suppkey % 13 = 0 then '' else concat('ry-', cast(s_suppkey % 90 as string)) end as hint
        from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    # a golden question on each part; its entities are the part itself and the one that it imports, and the third repository isn't ready
    "evaluated": """select case p_partkey % 4 when 0 then 'r2' when 1 then 'r3' else 'r1' end as repository_id, p_partkey as question_id, concat(case when p_size < 10 then 'Why ' when p_size < 12 then 'cycle? ' else 'What does it import: ' end, p_name) as text,
        case when p_size % 3 = 0 then 'hybrid' else 'pure_graph' end as expected, case when p_size % 7 = 0 then 'nothing' else concat('Part ', cast(p_partkey as string), '.') end as hint, split(concat('part ', cast(p_partkey as string), '.,PART ', cast(cast(floor(p_partkey / 3) as bigint) as string), '.'), ',') as entities from {part}""",
    "states": "select 'r1' as repository_id, 'ready' as status union all select 'r2', 'ready' union all select 'r3', 'failed'",
    "part_nodes": "select repository_id, p_partkey as ordinal, concat('p/', cast(p_partkey as string)) as id, 'file' as type, concat('Part ', cast(p_partkey as string), '.') as label from {part}, {states} as r where status = 'ready'",
    "told": "select repository_id, question_id, concat('It is part ', cast(question_id as string), '. ') as answer from {evaluated} as e where question_id % 2 = 0",
    "nested_nodes": """select repository_id, id, type, ordinal from (select 'r1' as repository_id union all select 'r2') as r, (
        select concat('method:', cast(p_partkey as string)) as id, 'method' as type, p_partkey + 10 as ordinal from {part} union all select concat('class:', cast(p_partkey as string)), 'class', p_partkey + 10 from {part}
        union all select concat('file:', cast(p_partkey as string)), 'file', p_partkey + 10 from {part} union all select distinct concat('folder:', cast(p_partkey % 20 as string)), 'folder', p_partkey % 20 + 1000000 from {part}
        union all select distinct concat('package:', p_brand), 'package', cast(substr(p_brand, 7) as bigint) from {part} union all select 'repository:r', 'repository', 9 from {region} where r_regionkey = 0) as n""",
    "nested_edges": """select repository_id, ordinal, source, target from (select 'r1' as repository_id union all select 'r2') as r, (
        select p_partkey as ordinal, concat('class:', cast(p_partkey as string)) as source, concat('method:', cast(p_partkey as string)) as target, 'r1 r2' as places from {part}
        union all select p_partkey, concat('file:', cast(p_partkey as string)), concat('class:', cast(p_partkey as string)), 'r1 r2' from {part}
        union all select p_partkey, concat('folder:', cast(p_partkey % 20 as string)), concat('file:', cast(p_partkey as string)), 'r1 r2' from {part}
        union all select p_partkey + 1, concat('folder:', cast((p_partkey + 1) % 20 as string)), concat('file:', cast(p_partkey as string)), 'r2' from {part} where p_size = 7
        union all select distinct p_partkey % 20, 'repository:r', concat('folder:', cast(p_partkey % 20 as string)), 'r1' from {part} where p_partkey % 20 <> 3) as e where contains(places, repository_id)""",
    "searched": "select distinct d.source as repository_id, b.item_id as query_id, b.text from {benchmark} as b join (select distinct source, cast(substr(source, 4) as int) % 5 as g from {documents}) as d on b.item_id % 5 = d.g",
    "failures": """select event_id, case event_id % 6 when 0 then 'Repository NOT found' when 1 then 'fatal: Authentication failed for x' when 2 then 'Permission denied (publickey)' when 3 then 'invalid argument'
        when 4 then 'connection reset' else cast(null as string) end as message from {events}""",
    "addresses": """select page_id, case page_id % 5 when 0 then concat(' https://github.com/own-', cast(page_id as string), '/re.po.git') when 1 then concat('https://github.com/o_1/r', cast(page_id as string), '/')
        when 2 then concat('http://github.com/o/r', cast(page_id as string)) when 3 then concat('https://github.com/o/r', cast(page_id as string), '/tree') else url end as url from {pages}""",
})

# Repositories


@query("select repository_id, count(*) as n_chunks, count(distinct path) as n_paths from {files} group by repository_id")
def repository_counts(spark, sf_dir):
    return repositories.chunk_counts(fixture(spark, sf_dir, "files"))


@query("select owner, repository_id, url, status, status not in ('ready', 'failed') as in_progress, row_number() over (partition by owner order by repository_id desc)::int as place from {repos}")
def owner_listing(spark, sf_dir):
    return repositories.listing(fixture(spark, sf_dir, "repos").withColumn("created_at", F.col("repository_id"))).select("owner", "repository_id", "url", "status", "in_progress", "place")


@query("select q.owner, q.url, r.repository_id is not null as found from {requests} as q left join (select * from {repos} where status = 'ready') as r on q.owner = r.owner and replace(trim(lower(q.url)), '.git', '') = r.url")
def owned_requests(spark, sf_dir):
    return repositories.owned(fixture(spark, sf_dir, "requests"), fixture(spark, sf_dir, "repos")).select("owner", "url", "found")


@query("""select r.repository_id, case when g.c is null then 'not_generated' else 'ready' end as status, g.c as commit_sha from (select repository_id from {repos}) as r left join (
  select job_id, 'c' || arg_max(event_id, ts::varchar || lpad(event_id::varchar, 12, '0')) as c from {jobs} where stage = 'complete' group by job_id) as g on g.job_id = r.repository_id""")  # fmt: skip
def graph_status(spark, sf_dir):
    versions = fixture(spark, sf_dir, "jobs").select(F.col("job_id").alias("repository_id"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("commit_sha"), F.when(F.col("stage") == "complete", "ready").otherwise("failed").alias("status"), F.col("ts").alias("created_at"))
    return govern.graph_of(fixture(spark, sf_dir, "repos"), versions).select("repository_id", "status", "commit_sha")


@query("select repository_id, type, count(*) as n, count(distinct id) as n_ids from {faulty_nodes} group by rollup(repository_id, type)")
def graph_counts(spark, sf_dir):
    return repositories.type_rollup(fixture(spark, sf_dir, "faulty_nodes"))


@query("select event_id, ts from {jobs} where ts + interval '2' day > (select max(ts) from events)")
def unexpired_rows(spark, sf_dir):
    j = fixture(spark, sf_dir, "jobs").select("event_id", "ts")
    return work.unexpired(j, j.agg(F.max("ts").alias("now")), 2)


@query("""with e as (select answer_id, seq, ts, kind, case when kind = 'token' and seq % 4 = 0 then text || '[src/a' || (seq % 8) || '.ts:1-2] [bad:x] ' else text end as text from {token_events}),
  x as (select answer_id, coalesce(string_agg(text, '' order by seq) filter (where kind = 'token'), '') as text, count(distinct seq % 8) filter (where kind = 'token' and seq % 4 = 0) as n_citations,
    floor((epoch_us(min(ts) filter (where kind = 'token')) - epoch_us(min(ts) filter (where kind = 'start'))) / 1000)::bigint as first_token_ms, floor((epoch_us(max(ts) filter (where kind <> 'start')) - epoch_us(min(ts) filter (where kind = 'token'))) / 1000)::bigint as ms,
    case when answer_id % 4 > 0 and count(*) filter (where kind = 'start') > 0 then answer_id % 7 * 1000 end as retrieval_ms from e group by answer_id)
  select answer_id, retrieval_ms, first_token_ms, ms as streaming_ms, length(text)::bigint as n_chars, case when ms > 0 then cast(round(length(text) * 1000 / ms) as bigint) end as chars_per_second, n_citations from x""")  # fmt: skip
def chat_turn_metrics(spark, sf_dir):
    return work.turn_metrics(fixture(spark, sf_dir, "turn_events"))


@query("select c_custkey, lower(c_mktsegment) || '@' || c_custkey || '.org' as email from customer")
def email_keys(spark, sf_dir):
    x = table(spark, sf_dir, "customer")
    raw = F.concat(F.lit(" \t"), "c_mktsegment", F.lit("@"), F.col("c_custkey").cast("string"), F.lit(".ORG\n"))
    return x.select("c_custkey", scalars.email_key(raw).alias("email"))


@query("select conv_id, string_agg(role || ': ' || text, chr(10) order by turn, role, text) as history from conversations where role is not null and text is not null group by conv_id")
def chat_history(spark, sf_dir):
    x = table(spark, sf_dir, "conversations").filter("role is not null and text is not null")
    x = x.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))  # one chat's turns
    return x.select("conv_id", F.array_join(F.transform("x", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n").alias("history"))


@query("select event_id, case when event_id % 6 < 3 then 'permanent' else 'retryable' end as category from events")
def failure_classes(spark, sf_dir):
    return fixture(spark, sf_dir, "failures").select("event_id", scalars.failure_class(F.col("message")).alias("category"))


@query("select page_id, case page_id % 5 when 0 then 'own-' || page_id when 1 then 'o_1' end as owner, case page_id % 5 when 0 then 're.po' when 1 then 'r' || page_id end as name from pages")
def repository_names(spark, sf_dir):
    return fixture(spark, sf_dir, "addresses").select("page_id", scalars.repository_name(F.col("url")).alias("r")).select("page_id", "r.owner", "r.name")


@query("""with c as (select repository_id, path, sha256(content) as content_hash from {files} where regexp_matches(content, '\\S')), held as (select distinct source as repository_id from documents where n_chars > 15000)
  select repository_id, path, content_hash, repository_id in (select repository_id from held) as reused from c""")  # fmt: skip
def checkpoint_reuse(spark, sf_dir):
    files = fixture(spark, sf_dir, "files")
    held = files.join(few(stage(files.filter("size > 15000").select("repository_id").distinct())), "repository_id", "left_semi")
    saved = held.filter(F.col("content").rlike(r"\S")).select("repository_id", "path", F.sha2("content", 256).alias("content_hash"))
    out = chunking.with_checkpoint(files, saved, ["repository_id"], lambda f: f.filter(F.col("content").rlike(r"\S")).select("repository_id", "path", F.sha2("content", 256).alias("content_hash")))
    return out.select("repository_id", "path", "content_hash", "reused")


# Answers

_CLOSE = """with recursive q as (select *, lower(text) as t from {asked}), c as (select repository_id as g, question_id, node, target, case when regexp_matches(t, '\\bwhy\\b') then 'hybrid' when regexp_matches(t, '\\bcycle\\b') then 'intelligence' else 'pure_graph' end as category,
  case when regexp_matches(t, '\\b(why|cycle)\\b') then null when regexp_matches(t, '\\bpath\\b.*\\bfrom\\b') then 'path' when regexp_matches(t, '\\bindirectly\\b') then 'transitive' else 'direct' end as mode,
  case when regexp_matches(t, '\\b(why|cycle)\\b|\\bpath\\b.*\\bfrom\\b') then null when regexp_matches(t, 'what does .+ depend on') then 'outgoing' when regexp_matches(t, 'who imports') then 'incoming' end as direction from q),
  e as (select distinct repository_id as g, source as a, target as b from {imports}), u as (select g, a, b, 'outgoing' as way from e union select g, b, a, 'incoming' from e),
  r as (select g, question_id, node as at, coalesce(direction, 'both') as way from c where mode = 'transitive' union select r.g, r.question_id, u.b, r.way from r join u on u.g = r.g and u.a = r.at and (r.way = 'both' or r.way = u.way)),
  p as (select g, question_id, target, [node] as path from c where mode = 'path' or category = 'hybrid' union all select p.g, p.question_id, p.target, list_append(path, e.b) from p join e on e.g = p.g and e.a = path[-1] where not list_contains(path, e.b) and path[-1] <> p.target),
  s as (select question_id, path from (select *, row_number() over (partition by question_id order by len(path), path) as k from p where path[-1] = target) where k = 1),
  n as (select distinct c.question_id, u.b as node from c join u on u.g = c.g and u.a = c.node and (c.direction is null or c.direction = u.way) where c.mode = 'direct' or c.category = 'hybrid'),
  a as (select c.g, c.question_id, c.mode, null::int as position, n.node from c join n using (question_id) where c.mode = 'direct' union all select c.g, c.question_id, c.mode, null, r.at from c join r using (question_id) where r.at <> c.node
    union all select c.g, c.question_id, c.mode, (unnest(range(len(path))))::int, unnest(path) from c join s using (question_id) where c.mode = 'path')"""
_CYCLES = """, h as (select g, a as x, b as y from e union select h.g, h.x, e.b from h join e on e.g = h.g and e.a = h.y), k as (select x.g, min(z.y) as cycle, x.x as node from h as x join h as z on z.g = x.g and z.x = x.x join h as f on f.g = x.g and f.x = z.y and f.y = x.x where x.x = x.y group by x.g, x.x)"""


def _asked(spark, sf_dir):
    return fixture(spark, sf_dir, "asked"), fixture(spark, sf_dir, "graph")


@query(_CLOSE + " select g as repository_id, question_id, mode, position, node from a")
def answer_rows(spark, sf_dir):
    return answers.answer_rows(*_asked(spark, sf_dir), edge_type="imports")


@query(_CLOSE + _CYCLES + """ select g as repository_id, question_id, category, case category when 'pure_graph' then 'dependency-analysis' when 'intelligence' then 'cycle-detection' end as algorithm, mode,
  case category when 'pure_graph' then (select count(*) from a where a.question_id = c.question_id) when 'intelligence' then (select count(distinct cycle) from k where k.g = c.g) end as found from c""")  # fmt: skip
def answer_summary(spark, sf_dir):
    return answers.answer_summary(*_asked(spark, sf_dir), edge_type="imports")


def _names(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_name").alias("label"))
    return fixture(spark, sf_dir, "states").filter("status = 'ready'").select("repository_id").join(names)


_TEXTS = _CLOSE + _CYCLES + """, w as (select k.g, cycle, string_agg(coalesce(p_name, node), ' → ' order by node) as line from k left join part on node = 'p/' || p_partkey group by 1, 2),
  y as (select g, count(*) as n, string_agg(line, chr(10) order by cycle) as lines from w group by g),
  t as (select question_id, case when mode = 'path' then string_agg(coalesce(p_name, a.node), ' → ' order by position) else string_agg(coalesce(p_name, a.node), ', ' order by a.node) end as answer from a left join part on a.node = 'p/' || p_partkey group by question_id, mode)
  select c.g as repository_id, c.question_id, case when category = 'intelligence' then case when y.n is null then 'No circular dependencies found in this repository.' else y.n || case when y.n = 1 then ' circular dependency found:' else ' circular dependencies found:' end || chr(10) || y.lines end
    else coalesce(t.answer, case when mode = 'path' then 'No path exists between these components.' else 'None found.' end) end as answer from c left join t using (question_id) left join y on y.g = c.g where c.category <> 'hybrid'"""


@query(_TEXTS)
def answer_texts(spark, sf_dir):
    return answers.answer_texts(*_asked(spark, sf_dir), _names(spark, sf_dir), "imports")


_FACTS = _CLOSE + """, f as (select c.g, question_id, 'neighbours' as fact, null::int as position, n.node from c join n using (question_id) where category = 'hybrid'
  union all select c.g, question_id, 'path', (unnest(range(len(path))))::int, unnest(path) from c join s using (question_id) where category = 'hybrid')"""


@query(_FACTS + " select g as repository_id, question_id, fact, position, node from f")
def graph_facts(spark, sf_dir):
    return answers.graph_facts(*_asked(spark, sf_dir), edge_type="imports")


_QUOTED = retrieval.RULES.replace("'", "''"), retrieval.REFUSAL.replace("'", "''")
_BOTH = retrieval.FACTS.replace("'", "''"), retrieval.AFTER_FACTS.replace("'", "''")


@query(_FACTS + f""", l as (select question_id, string_agg(node, ', ' order by position, node) filter (where fact = 'neighbours') as near, string_agg(node, ', ' order by position, node) filter (where fact = 'path') as way from f group by 1),
  b as (select conv_id, string_agg('--- Context ' || k || ': chat:' || turn || '-' || (turn + 1) || ' - ' || coalesce(role, '') || ' ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by k) as b from (select *, row_number() over (partition by conv_id order by turn, text) as k from conversations) as x group by conv_id),
  z as (select c.*, case when b is null then '{_QUOTED[1]}' else '{_QUOTED[0]}' || chr(10) || chr(10) || b end as base, near, way from c left join l using (question_id) left join b on b.conv_id = c.question_id where category = 'hybrid')
  select g as repository_id, question_id, '{_BOTH[0]}' || chr(10) || 'Direct dependencies/dependents of ' || node || ': ' || coalesce(near, '(none found)') || chr(10) || 'Dependency path from ' || node || ' to ' || target || ': ' || coalesce(way, '(none found)') || chr(10) || chr(10) || '{_BOTH[1]}' || chr(10) || chr(10) || base as prompt from z""")  # fmt: skip
def hybrid_prompts(spark, sf_dir):
    asked, edges = _asked(spark, sf_dir)
    x = table(spark, sf_dir, "conversations")
    w = retrieval.Window.partitionBy("conv_id").orderBy("turn", "text")
    blocks = x.select(F.col("conv_id").alias("question_id"), F.row_number().over(w).alias("rank"), scalars.location_label(F.lit("chat"), F.col("turn"), F.col("turn") + 1).alias("location"), scalars.symbol_label(F.lit(None).cast("string"), F.coalesce("role", F.lit(""))).alias("label"), F.coalesce("text", F.lit("")).alias("content"))
    key = ["repository_id", "question_id"]
    # the patterns cost more than the scan, so only these are classified again
    asked = stage(answers.classified(asked).filter("category = 'hybrid'").select(*key, "text", "node", "target"))
    hybrid = asked.select(*key)
    facts = answers.fact_lines(asked, answers.graph_facts(asked, edges, "imports"))
    return retrieval.hybrid_prompts(hybrid, blocks.join(hybrid, "question_id"), facts, key)


@query("""with n as (select repository_id, label, min(ordinal)::double as position, max_by(id, ordinal) as id from {labels_of} group by 1, 2 union all select repository_id, 'repository', ordinal + 0.5, id from {labels_of} where type = 'repository')
  select h.repository_id, h.question_id, h.hint, (select min_by(n.id, n.position) from n where n.repository_id = h.repository_id and contains(lower(n.label), lower(h.hint))) as id from {hints} as h""")  # fmt: skip
def hint_resolution(spark, sf_dir):
    return answers.resolved_hints(fixture(spark, sf_dir, "hints"), fixture(spark, sf_dir, "labels_of")).select("repository_id", "question_id", "hint", "id")


_SUGGESTED = " union all ".join(f"select '{t}' as type, {i} as rank, '{q.replace(chr(39), chr(39) * 2)}' as question" for t, qs in {**answers.SUGGESTIONS, "": answers.SUGGESTIONS_ELSE}.items() for i, q in enumerate(qs))


@query(f"""with s as ({_SUGGESTED}), n as ({ORACLE_SQL["annotation_nodes"]}) select n.repository_id, n.id, s.rank::int as rank, s.question from n
  join s on s.type = case when n.type in (select type from s) then n.type else '' end""")  # fmt: skip
def suggested_questions(spark, sf_dir):
    return answers.suggestions(annotations.nodes(fixture(spark, sf_dir, "answered")))


@query("""with recursive e as (select *, case when p_size < 10 then 'hybrid' when p_size < 12 then 'intelligence' else 'pure_graph' end as kind, case p_partkey % 4 when 0 then 'r2' when 1 then 'r3' else 'r1' end as g from part),
  i as (select distinct repository_id as g, source, target from {imports}), u as (select g, source as a, target as b from i union select g, target, source from i),
  h as (select g, source as x, target as y from i union select h.g, h.x, i.target from h join i on i.g = h.g and i.source = h.y),
  k as (select x.g, min(z.y) as cycle, x.x as node from h as x join h as z on z.g = x.g and z.x = x.x join h as f on f.g = x.g and f.x = z.y and f.y = x.x where x.x = x.y group by x.g, x.x),
  w as (select k.g, cycle, string_agg(case when p_partkey is null then node else 'Part ' || p_partkey || '.' end, ' → ' order by node) as line from k left join part on node = 'p/' || p_partkey group by 1, 2),
  y as (select g, count(*) || case when count(*) = 1 then ' circular dependency found:' else ' circular dependencies found:' end || chr(10) || string_agg(line, chr(10) order by cycle) as told from w group by g),
  d as (select p_partkey, string_agg('Part ' || b[3:] || '.', ', ' order by b) as answer from e join u on u.g = e.g and u.a = 'p/' || p_partkey where p_size % 7 <> 0 and kind = 'pure_graph' group by 1),
  t as (select e.*, case when e.g = 'r3' then null when kind = 'hybrid' then case when p_partkey % 2 = 0 then 'It is part ' || p_partkey || '. ' end when kind = 'pure_graph' then coalesce(d.answer, 'None found.') else coalesce(y.told, 'No circular dependencies found in this repository.') end as answer
    from e left join d using (p_partkey) left join y on y.g = e.g),
  x as (select g as repository_id, p_partkey as question_id, case when p_size % 3 = 0 then 'hybrid' else 'pure_graph' end as expected, case when answer is null then 'error' else kind end as actual,
    coalesce(contains(lower(answer), 'part ' || p_partkey || '.'), false) as f1, coalesce(contains(lower(answer), 'part ' || floor(p_partkey / 3)::bigint || '.'), false) as f2 from t)
  select repository_id, question_id, expected, actual, f1::int + f2::int as n_found from x""")  # fmt: skip
def evaluation_run(spark, sf_dir):
    labels = fixture(spark, sf_dir, "part_nodes").select("repository_id", F.col("id").alias("node"), "label")
    graph_edges = fixture(spark, sf_dir, "graph").filter("type = 'imports'")
    run = answers.evaluation_run(fixture(spark, sf_dir, "evaluated"), fixture(spark, sf_dir, "states"), fixture(spark, sf_dir, "part_nodes"), graph_edges, labels, fixture(spark, sf_dir, "told"))
    return run.select("repository_id", "question_id", "expected", "actual", F.size("found").alias("n_found"))


@query("""with recursive e as (select repository_id as g, source, target from {graph}), r as (select g, source as a, target as b from e union select r.g, r.a, e.target from r join e on e.g = r.g and e.source = r.b),
  n as (select g, source as id from e union select g, target from e), t as (select g, 'p/3' as s from (select distinct g from e) as y),
  x as (select n.g, id, exists (select 1 from r where r.g = n.g and a = id and b = id) as in_cycle, id <> s and (exists (select 1 from e where e.g = n.g and source = s and target = id) or exists (select 1 from e where e.g = n.g and target = s and source = id)) as related, id <> s as other from n join t on t.g = n.g)
  select g as repository_id, id, in_cycle, related, other and not related as dimmed from x""")  # fmt: skip
def display_flags(spark, sf_dir):
    e = fixture(spark, sf_dir, "graph")
    selected = e.select("repository_id", F.lit("p/3").alias("node")).distinct()
    return answers.display_flags(e.select("repository_id", F.explode(F.array("source", "target")).alias("id")), e, selected)


@query("""with p as (select repository_id as g, target as id, max_by(source, ordinal) as parent from {nested_edges} group by 1, 2), n as (select x.repository_id as g, x.id, x.type, x.ordinal, parent from {nested_nodes} as x left join p on p.g = x.repository_id and p.id = x.id),
  h as (select g, min_by(id, ordinal) as root from n where parent is null and id in (select source from {nested_edges} as y where y.repository_id = n.g) group by g),
  k as (select n.*, root from n left join h on h.g = n.g)
  select k.g as repository_id, k.id, k.parent, case k.type when 'folder' then k.parent when 'file' then k.parent when 'class' then a.parent when 'method' then b.parent end as container,
    case when k.id = root then 'hierarchy_root' when k.parent is null then 'standalone' end as role from k left join n as a on a.g = k.g and a.id = k.parent left join n as b on b.g = k.g and b.id = a.parent""")  # fmt: skip
def containment_hierarchy(spark, sf_dir):
    return answers.hierarchy(fixture(spark, sf_dir, "nested_nodes"), fixture(spark, sf_dir, "nested_edges"))


# Retrieval

_VECTORS = """words as (select repository_id, id, ('0x' || md5(unnest(regexp_extract_all(lower(content), '[a-z0-9]+')))[1:2])::int % 64 as b from texts),
  cells as (select repository_id, id, b, count(*)::double as n from words group by 1, 2, 3), unit as (select repository_id, id, b, n / sqrt(sum(n * n) over (partition by repository_id, id)) as x from cells)"""


@query("with texts as (select repository_id, path as id, content from {files}), " + _VECTORS + """ select path, coalesce(string_agg(b || '=' || round(x * 1000000)::bigint, ' ' order by b) filter (where x is not null), '') as vector
  from {files} as f left join unit on unit.repository_id = f.repository_id and unit.id = f.path group by path""")  # fmt: skip
def text_embeddings(spark, sf_dir):
    x = retrieval.embedded(fixture(spark, sf_dir, "files"))
    cells = F.filter(F.transform("v", lambda c, b: F.when(c > 0, F.concat(b.cast("string"), F.lit("="), F.round(c * 1000000).cast("long").cast("string")))), lambda s: s.isNotNull())
    return x.select("path", F.array_join(cells, " ").alias("vector"))


@query("with texts as (select repository_id, 'c' || doc_id as id, content from {files} union all select repository_id, 'q' || query_id, text from {searched}), " + _VECTORS + """,
  s as (select c.repository_id, q.id as query_id, c.id as chunk_id, round(sum(c.x * q.x), 6) as score from unit as c join unit as q on q.repository_id = c.repository_id and q.b = c.b and q.id like 'q%' and c.id like 'c%' group by 1, 2, 3),
  z as (select f.repository_id, q.query_id, f.doc_id as chunk_id, coalesce(s.score, 0.0) as score from {files} as f join {searched} as q using (repository_id) left join s on s.repository_id = f.repository_id and s.query_id = 'q' || q.query_id and s.chunk_id = 'c' || f.doc_id
    where regexp_matches(lower(f.content), '[a-z0-9]') and regexp_matches(lower(q.text), '[a-z0-9]'))
  select * from (select repository_id, query_id, chunk_id, score, (row_number() over (partition by repository_id, query_id order by score desc, chunk_id))::int as rank from z) where rank <= 8""")  # fmt: skip
def question_retrieval(spark, sf_dir):
    chunks = fixture(spark, sf_dir, "files").select("repository_id", F.col("doc_id").alias("chunk_id"), "content")
    return retrieval.retrieved(fixture(spark, sf_dir, "searched"), chunks)


@query(f"""with c as (select conv_id, turn, row_number() over (partition by conv_id order by turn, text)::int as rank, role, text from conversations where role = 'assistant'),
  p as (select conv_id, string_agg('--- Context ' || rank || ': turn:' || turn || ' - ' || role || ' ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by rank) as b from c group by conv_id)
  select conv_id, case when b is null then '{_QUOTED[1]}' else '{_QUOTED[0]}' || chr(10) || chr(10) || b end as prompt from (select distinct conv_id from conversations) as x left join p using (conv_id)""")  # fmt: skip
def system_prompts(spark, sf_dir):
    x = table(spark, sf_dir, "conversations")
    w = retrieval.Window.partitionBy("conv_id").orderBy("turn", "text")
    blocks = x.filter("role = 'assistant'").select("conv_id", F.row_number().over(w).alias("rank"), F.concat(F.lit("turn:"), F.col("turn").cast("string")).alias("location"), F.col("role").alias("label"), F.coalesce("text", F.lit("")).alias("content"))
    return retrieval.system_prompts(x.select("conv_id").distinct(), blocks, "conv_id")


@query("""with x as (select *, row_number() over (partition by job_id order by ts desc, event_id desc) as r from {jobs})
  select job_id, event_id, stage, ts from x where r = 1 and attempts < 3 and ts <= (select max(ts) from events) - interval '20' minute and (stage in ('cloning', 'parsing', 'embedding') or (stage = 'failed' and failure = 'retryable'))""")  # fmt: skip
def stream_stale_jobs(spark, sf_dir):
    return jobs.stale_job_stream(spark, sf_dir)
