"""Queries on source code, annotations, evaluation and streams of jobs; importing this module registers them.

Sources and annotations are made from whole tables by SQL. The SQL of `import_specifiers` and of the annotations derives
the expected rows from the same keys without any parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import annotations, evaluation, govern, graph, imports, retrieval, structure
from lodestone.plans.registry import FIXTURES, ORACLE_SQL, fixture, query
from lodestone.streaming import jobs

_EXT = "case p_partkey % 3 when 0 then '.py' when 1 then '.ts' else '.js' end"
_PATH = "concat('src/d', cast(p_partkey % 20 as string), '/m', cast(p_partkey as string), " + _EXT + ")"
_FLAG = {"isRoute": 2, "isService": 3, "isController": 5, "isDbModel": 7, "isCache": 11, "isQueue": 13, "isEvent": 17, "isConfiguration": 19, "isAuthComponent": 23}
_JSON = ", ',', ".join(f"'\"{f}\":', case when o_orderkey % {m} = 0 then {chr(39) + 'true' + chr(39)} else 'false' end" for f, m in _FLAG.items())
_JSON = _JSON.replace("'\"isCache\":', case when", "'\"isCache\":', case when o_orderkey % 29 = 1 then '\"true\"' when")

FIXTURES.update({
    # two repositories that share paths; the second lacks many files of the first
    "code": f"""select repository_id, p_partkey, {_PATH} as path, case when p_partkey % 3 = 0
        then concat('import os, a', cast(p_size as string), '.b as c', chr(10), '# import gone', chr(10), 'from .m', cast(p_partkey + 60 as string), ' import y', chr(10), 'def f(x):', chr(10), '    return x', chr(10))
        else concat('// import z from "./gone"', chr(10), 'import x from "./m', cast(p_partkey + 60 as string), '";', chr(10), '/* require("./gone") */', chr(10),
          'import y from "../d', cast((p_partkey + 1) % 20 as string), '/m', cast(p_partkey + 1 as string), '";', chr(10), 'const q = require("@s/p', cast(p_size as string), '/sub");', chr(10), 'export * from "./none";', chr(10),
          'export class C', cast(p_partkey as string), ' ', chr(123), chr(10), '  run(a) ', chr(123), chr(10), '    return "', chr(125), '";', chr(10), '  ', chr(125), chr(10), chr(125), chr(10), 'function g() ', chr(123), ' return 1; ', chr(125)) end as content from {{part}} join (select 'r1' as repository_id, 50 as most union all select 'r2', 30) as r on p_size <= most""",
    "answered": f"""select concat('r', cast(o_custkey % 7 as string)) as repository_id, o_custkey % 20 as batch, o_orderkey as ordinal, concat('src/o', cast(o_orderkey as string), '.ts') as path, case when o_orderkey % 31 = 0 then 429 when o_orderkey % 37 = 0 then 500 else 200 end as status,
        concat(case when o_orderkey % 4 = 0 then concat('```json', chr(10)) else '' end, chr(123), {_JSON}, case when o_orderkey % 6 = 0 then ',"httpMethod":"get","httpPath":"/o"' else ',"httpMethod":null' end,
          case when o_orderkey % 41 = 0 then '' else chr(125) end, case when o_orderkey % 4 = 0 then concat(chr(10), '```') else '' end) as answer from {{orders}}""",
    "results": """select p_partkey as question_id, p_size < 25 as correct, concat(p_name, ' belongs to ', lower(p_brand), '.') as answer, p_brand as a, p_type as b from {part}""",
    "repos": "select c_custkey as repository_id, c_custkey % 25 as owner, concat('https://github.com/o/', cast(c_custkey as string)) as url, case when c_custkey % 5 = 0 then 'failed' else 'ready' end as status from {customer} where c_acctbal > 0",
    "requests": "select distinct o_custkey % 25 as owner, concat(case when o_custkey % 3 = 0 then ' HTTPS://GitHub.com/O/' else 'https://github.com/o/' end, cast(o_custkey as string), case when o_custkey % 2 = 0 then '.git' else '' end) as url from {orders}",
    "asked": """select case when p_partkey % 3 = 0 then 'r2' else 'r1' end as repository_id, p_partkey as question_id, concat('p/', cast(p_partkey as string)) as node, concat('p/', cast(cast(floor(p_partkey / 9) as bigint) as string)) as target,
        case when p_size < 10 then concat('Why does ', p_name, ' matter?') when p_size < 15 then concat('Is there a cycle near ', p_name, '?')
        when p_size < 30 then concat('What is the path from ', p_name, ' to ', p_type, '?') when p_size < 35 then concat('What does ', p_name, ' depend on?')
        when p_size < 37 then concat('Who imports ', p_name, ' indirectly?') when p_size < 42 then concat('What does ', p_name, ' depend on indirectly?') else concat('Imports of ', p_name) end as text from {part}""",
    "sse": """select conv_id, turn, case when turn % 7 = 3 then 'data: broken' when turn % 7 = 2 then 'event: token' when turn % 7 = 6 then concat('event: done', chr(10), 'data: ', chr(123), chr(125)) when turn % 7 = 5 then concat('event: error', chr(10), 'data: ', chr(123), chr(125))
        else concat('event: token', chr(10), 'data: ', chr(123), '"token":"t', cast(turn as string), '"', chr(125)) end as block from {conversations}""",
})


_KEYS = "with k as (select repository_id as g, p_partkey as p, p_size as s, " + _PATH.replace("string", "varchar") + " as path from part join (select 'r1' as repository_id, 50 as most union all select 'r2', 30) as r on p_size <= most)"


@query(_KEYS + """,
  x as (select g, path, unnest(case when p % 3 = 0 then ['os', 'a' || s || '.b', '.m' || (p + 60)] else ['./m' || (p + 60), '../d' || ((p + 1) % 20) || '/m' || (p + 1), '@s/p' || s || '/sub'] end) as specifier from k)
  select g as repository_id, path, specifier from x""")  # fmt: skip
def import_specifiers(spark, sf_dir):
    return imports.specifiers(fixture(spark, sf_dir, "code")).select("repository_id", "path", "specifier")


_RESOLVED = _KEYS + """,
  e as (select a.g, a.path as path, b.path as target, case when a.p % 3 = 0 then '.m' || b.p else './m' || b.p end as specifier from k as a join k as b on b.g = a.g and b.p = a.p + 60
    union all select a.g, a.path, b.path, '../d' || (b.p % 20) || '/m' || b.p from k as a join k as b on b.g = a.g and b.p = a.p + 1 where a.p % 3 > 0)"""


@query(_RESOLVED + " select g as repository_id, path, specifier, target from e")
def resolved_imports(spark, sf_dir):
    x = fixture(spark, sf_dir, "code")
    return imports.resolved(imports.specifiers(x), x)


_BARE = "(select g, path, unnest(case when p % 3 = 0 then ['os', 'a' || s] else ['@s/p' || s] end) as name from k)"


@query(_RESOLVED + f""", b as (select g, 'file:' || path as source, 'file:' || target as target from e union select g, 'file:' || path, 'package:' || name from {_BARE} as y)
  select g as repository_id, 'edge:' || source || '->imports->' || target as id, source, target, 'imports' as type from b""")  # fmt: skip
def import_edges(spark, sf_dir):
    x = fixture(spark, sf_dir, "code")
    return imports.import_edges(imports.specifiers(x), x)


@query(_KEYS + f" select distinct g as repository_id, 'package:' || name as id, 'package' as type, name as label from {_BARE} as y")
def package_nodes(spark, sf_dir):
    return imports.package_nodes(imports.specifiers(fixture(spark, sf_dir, "code")))


_CHUNKS = _KEYS + """,
  t(py, kind, name, s, e) as (values (true, 'window', null, 1, 3), (true, 'function', 'f', 4, 5), (false, 'window', null, 1, 7), (false, 'method', '.run', 8, 10), (false, 'window', null, 11, 11), (false, 'function', 'g', 12, 12)),
  c as (select g as repository_id, path, kind, case when kind = 'method' then 'C' || p || name else name end as name, t.s::int as start_line, t.e::int as end_line from k join t on t.py = (p % 3 = 0))"""


@query(_CHUNKS + " select * from c")
def structure_chunks(spark, sf_dir):
    return structure.chunks(fixture(spark, sf_dir, "code")).drop("chunk")


@query(_CHUNKS + " select repository_id, kind || ':' || path || '#' || name as id, kind as type, name as label, path from c where name is not null")
def symbol_nodes(spark, sf_dir):
    return govern.symbols(structure.chunks(fixture(spark, sf_dir, "code")))[0]


@query(_CHUNKS + " select repository_id, 'edge:' || source || '->contains->' || target as id, source, target, 'contains' as type from (select repository_id, 'file:' || path as source, kind || ':' || path || '#' || name as target from c where name is not null) as x")
def symbol_edges(spark, sf_dir):
    return govern.symbols(structure.chunks(fixture(spark, sf_dir, "code")))[1]


_OK = "o_orderkey % 29 <> 1 and o_orderkey % 41 <> 0"


_ANNOTATED = "with t(type, m) as (values " + ", ".join(f"('{annotations.FLAGS[f]}', {m})" for f, m in _FLAG.items() if f != "isRoute") + f"""), o as (select *, 'r' || (o_custkey % 7) as g, 'src/o' || o_orderkey || '.ts' as path from orders where {_OK}),
  a as (select g as repository_id, type || ':' || path as id, type, path as label, path from o join t on o_orderkey % m = 0 union all select g, 'route:GET:/o', 'route', 'get /o', path from o where o_orderkey % 6 = 0)"""


@query(_ANNOTATED + " select * from a")
def annotation_nodes(spark, sf_dir):
    return annotations.nodes(fixture(spark, sf_dir, "answered"))


@query(_ANNOTATED + " select repository_id, 'edge:file:' || path || '->defines->' || id as id, 'file:' || path as source, id as target, 'defines' as type from a")
def annotation_edges(spark, sf_dir):
    return annotations.edges(fixture(spark, sf_dir, "answered"))


@query(f"""with o as (select o_custkey % 20 as batch, o_orderkey as k, o_orderkey % 31 = 0 as quota, o_orderkey % 31 <> 0 and o_orderkey % 37 <> 0 and {_OK} as good from orders)
  select batch, count(*) as attempted, count(*) filter (where good) as succeeded, count(*) filter (where quota) as quota_exhausted, count(*) filter (where not good and not quota) as failed,
  round(100 * count(*) filter (where good) / count(*), 1) as percent, 'src/o' || min(k) filter (where quota) || '.ts' as first_over from o group by batch""")  # fmt: skip
def annotation_coverage(spark, sf_dir):
    return annotations.coverage(fixture(spark, sf_dir, "answered"), "batch")


@query("select repository_id, path, content[1:4000] as excerpt from {files}")
def annotation_prompts(spark, sf_dir):
    return annotations.prompts(fixture(spark, sf_dir, "files"))


def _results(spark, sf_dir):
    found, missing = evaluation.entities(F.col("answer"), F.array("a", "b"))
    return fixture(spark, sf_dir, "results").select("question_id", "correct", found.alias("found"), missing.alias("missing"))


_SCORED = "with r as (select question_id, correct, list_filter([a, b], lambda e: contains(lower(answer), lower(e))) as f, list_filter([a, b], lambda e: not contains(lower(answer), lower(e))) as m from {results})"


@query(_SCORED + " select question_id, array_to_string(f, ',') as found, array_to_string(m, ',') as missing from r")
def entity_scores(spark, sf_dir):
    return _results(spark, sf_dir).select("question_id", F.array_join("found", ",").alias("found"), F.array_join("missing", ",").alias("missing"))


@query(_SCORED + " select count(*) as n, round(avg(correct::int), 6) as routing_accuracy, round(avg(len(f) / (len(f) + len(m))), 6) as entity_recall from r")
def evaluation_report(spark, sf_dir):
    return evaluation.report(_results(spark, sf_dir))


@query("""select q.owner, q.url, r.repository_id, case when r.repository_id is null then 'create' when r.status <> 'failed' and exists (select 1 from events where user_id = r.repository_id) then 'reuse' else 'restart' end as action
  from {requests} as q left join {repos} as r on r.owner = q.owner and lower(r.url) = replace(trim(lower(q.url)), '.git', '')""")  # fmt: skip
def import_plan(spark, sf_dir):
    j = fixture(spark, sf_dir, "jobs").select(F.col("job_id").alias("repository_id"))
    return evaluation.import_plan(fixture(spark, sf_dir, "requests"), fixture(spark, sf_dir, "repos"), j)


@query("""with e as (select job_id, stage, epoch_us(lead(ts) over (partition by job_id order by ts, event_id)) - epoch_us(ts) as us from {jobs}), s as (select job_id, stage, sum(us) as us from e where us is not null group by 1, 2)
  select job_id, count(*) as n_stages, round(sum(us) / 1e6, 3) as total_seconds, (list(stage order by us desc, stage))[1] as bottleneck from s group by job_id""")  # fmt: skip
def stage_times(spark, sf_dir):
    return evaluation.stage_times(fixture(spark, sf_dir, "jobs"))


@query("""with e as (select job_id, stage, epoch_us(lead(ts) over (partition by job_id order by ts, event_id)) - epoch_us(ts) as us from {jobs}), s as (select job_id, stage, sum(us) as us from e where us is not null group by 1, 2)
  select job_id, stage, round(us / 1e6, 3) as seconds, round(us / nullif(sum(us) over (partition by job_id), 0), 6) as share from s""")  # fmt: skip
def stage_durations(spark, sf_dir):
    return evaluation.stage_seconds(fixture(spark, sf_dir, "jobs"))


_CLEAN = """with n as (select * from {faulty_nodes} where certainty in ('deterministic', 'inferred') and label is not null), k as (select * from {faulty_edges} as e where type <> '' and certainty in ('deterministic', 'inferred')
  and exists (select 1 from n where n.repository_id = e.repository_id and n.id = e.source) and exists (select 1 from n where n.repository_id = e.repository_id and n.id = e.target))"""


@query(_CLEAN + " select repository_id, id, source, target from k")
def sanitised_edges(spark, sf_dir):
    return evaluation.sanitised(fixture(spark, sf_dir, "faulty_nodes"), fixture(spark, sf_dir, "faulty_edges"))[1].select("repository_id", "id", "source", "target")


@query(_CLEAN + """, c as (select repository_id, (select count(*) from n where n.repository_id = r.repository_id) as n_nodes, (select count(*) from k where k.repository_id = r.repository_id) as n_edges, (select count(*) from k where k.repository_id = r.repository_id and type = 'contains') as n_contains,
    (select count(*) from {faulty_nodes} as x where x.repository_id = r.repository_id) as a, (select count(*) from {faulty_edges} as x where x.repository_id = r.repository_id) as b from (select distinct repository_id from {faulty_nodes}) as r)
  select repository_id, n_nodes, n_edges, n_contains, a - n_nodes as dropped_nodes, b - n_edges as dropped_edges from c""")  # fmt: skip
def sanitised_graph_counts(spark, sf_dir):
    return evaluation.sanitised(fixture(spark, sf_dir, "faulty_nodes"), fixture(spark, sf_dir, "faulty_edges"))[2]


@query("""with p as (select repository_id, string_split(path, '/') as p from {tree}), x as (select distinct repository_id, i as depth, case when i = len(p) then 'file:' else 'folder:' end || array_to_string(p[1:i], '/') as node from (select repository_id, p, unnest(range(1, len(p) + 1)) as i from p))
  select repository_id, node, depth::int as depth from x""")  # fmt: skip
def containment_depth(spark, sf_dir):
    edges = govern.containment(fixture(spark, sf_dir, "tree"))[1]
    roots = edges.filter(F.col("source").startswith("repository:")).select("repository_id", F.col("source").alias("seed"))
    return graph.reach(roots, edges).filter("depth > 0").select("repository_id", "node", "depth")


_FIRST = """select repository_id, node, other, direction, rank from (select *, (row_number() over (partition by repository_id, node, direction order by other))::int as rank from (
  select repository_id, source as node, target as other, 'outgoing' as direction from {graph} union select repository_id, target, source, 'incoming' from {graph}) as u) as x where rank <= 8"""


@query(_FIRST)
def first_relations(spark, sf_dir):
    return graph.first_relations(fixture(spark, sf_dir, "graph"))


@query("with f as (" + _FIRST + """), t as (select repository_id, node, string_agg('- ' || direction || ': ' || other, chr(10) order by direction, rank) as facts from f group by 1, 2)
  select q.repository_id, question_id, case when facts is null then text else 'Graph facts:' || chr(10) || facts || chr(10) || chr(10) || text end as prompt from {asked} as q left join t on t.repository_id = q.repository_id and t.node = q.node""")  # fmt: skip
def graph_prompts(spark, sf_dir):
    return retrieval.graph_prompt(fixture(spark, sf_dir, "asked"), graph.first_relations(fixture(spark, sf_dir, "graph")))


@query("""with recursive e as (select distinct repository_id as g, source, target from {imports}), r as (select distinct g, source as seed, source as node, [source] as path from e
  union all select r.g, r.seed, e.target, list_append(r.path, e.target) from r join e on e.g = r.g and e.source = r.node where not list_contains(r.path, e.target)),
  d as (select *, row_number() over (partition by g, seed, node order by len(path), path) as k from r) select g as repository_id, seed, node, array_to_string(path, ' > ') as path from d where k = 1""")  # fmt: skip
def shortest_paths(spark, sf_dir):
    e = fixture(spark, sf_dir, "graph")
    asked = e.filter("type = 'imports'").select("repository_id", F.col("source").alias("seed"), F.lit(None).cast("string").alias("node")).distinct()
    return graph.shortest_paths(asked, e, "imports").select("repository_id", "seed", "node", F.array_join("path", " > ").alias("path"))


@query("select conv_id, turn, case turn % 7 when 6 then 'done' when 5 then 'error' when 3 then null when 2 then null else 'token' end as kind, case turn % 7 when 5 then 'The response was interrupted.' when 6 then null when 3 then null when 2 then null else 't' || turn end as text from conversations")
def stream_events(spark, sf_dir):
    return fixture(spark, sf_dir, "sse").select("conv_id", "turn", scalars.stream_event(F.col("block")).alias("e")).select("conv_id", "turn", "e.kind", "e.text")


@query("""select event_id, '{"n":' || event_id || ',"req":{"headers":{"cookie":"[Redacted]","host":"h"},"password":"[Redacted]"},"token":"kept","user":{"name":"u' || user_id || '","token":"[Redacted]"}}' as record from events where event_id % 5 <> 0
  union all select event_id, 'plain ' || event_id from events where event_id % 5 = 0""")  # fmt: skip
def redacted_fields(spark, sf_dir):
    return fixture(spark, sf_dir, "records").select("event_id", scalars.redacted_fields(F.col("record")).alias("record"))


# braces stand for tables in a fixture, so those of JSON are written as characters
_RECORD = """concat('{"user":{"token":"t', cast(event_id as string), '","name":"u', cast(user_id as string), '"},"token":"kept","req":{"password":7,"headers":{"host":"h","cookie":"c"}},"n":', cast(event_id as string), '}')"""
_RECORD = _RECORD.replace("{", "', chr(123), '").replace("}", "', chr(125), '")
FIXTURES["records"] = f"select event_id, case when event_id % 5 = 0 then concat('plain ', cast(event_id as string)) else {_RECORD} end as record from {{events}}"


@query(ORACLE_SQL["latest_job"].replace("select job_id, event_id, stage, ts from", "select job_id, event_id, stage from"))
def stream_job_state(spark, sf_dir):
    return jobs.job_state_stream(spark, sf_dir)


@query("select distinct repository_id, sha256(content) as content_hash from {files}")
def stream_ingest(spark, sf_dir):
    return jobs.ingest_stream(spark, sf_dir)


# an answer ends with its first done or error event, or before a pause; those are given out that the watermark has passed
@query("""with e as (select user_id, event_id, event_type, epoch_us(ts) as us, case when lag(event_type) over w in ('error', 'signup') then 1 when epoch_us(ts) - lag(epoch_us(ts)) over w < 1800000000 then 0 else 1 end as opens
    from events window w as (partition by user_id order by ts, event_id)),
  s as (select *, sum(opens) over (partition by user_id order by us, event_id rows unbounded preceding) as k from e),
  w as (select (max(epoch_us(ts)) // 1000 - 600000) * 1000 as mark from events),
  a as (select user_id, min(us) as start, max(us) as last, count(*) filter (where event_type not in ('error', 'signup')) as n_tokens, coalesce(string_agg(event_type, '' order by event_id) filter (where event_type not in ('error', 'signup')), '') as text,
    case max(case event_type when 'error' then 2 when 'signup' then 1 else 0 end) when 2 then 'error' when 1 then 'done' else 'open' end as state from s group by user_id, k)
  select user_id as answer_id, make_timestamp(start) as session_start, n_tokens, length(text) as n_chars, state, text from a, w where last + case when state = 'open' then 1800000000 else 0 end <= mark""")  # fmt: skip
def stream_tokens(spark, sf_dir):
    return jobs.token_stream(spark, sf_dir)
