"""All registered queries of the library and the equivalent DuckDB SQL.

`FIXTURES` derives repositories, files, jobs, questions and annotations from the given tables by SQL that both engines
run; they are whole-table views, so every query's work grows with its tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import chunking, evaluation, govern, graph, retrieval, vectors, work
from lodestone.sources import trees
from lodestone.sources.tables import scan_filter, shared_dir, table
from lodestone.streaming import jobs

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations", "labels", "pages")
EXT = "case lang when 'en' then '.md' when 'fr' then '.json' when 'de' then '.py' else '.go' end"

FIXTURES = {
    "files": f"select source as repository_id, concat(source, '/', lang, '/', cast(doc_id as string), {EXT}) as path, text as content, n_chars as size, doc_id from {{documents}}",
    "tree": "select r_name as repository_id, concat(n_name, '/', cast(c_custkey as string), '.md') as path from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey union select r_name, concat('docs/', cast(c_custkey % 50 as string), '.md') from {customer}, {region}",
    # two repositories whose nodes have the same names, and edges of another type among them
    "graph": """select repository_id, source, target, type, concat('edge:', source, '->', type, '->', target) as id from (
        select 'r1' as repository_id, concat('p/', cast(p_partkey as string)) as source, concat('p/', cast(cast(floor(p_partkey / 3) as bigint) as string)) as target, 'imports' as type from {part}
        union select 'r1', concat('p/', cast(cast(floor(p_partkey / 3) as bigint) as string)), concat('p/', cast(p_partkey as string)), 'imports' from {part} where p_size = 1
        union select 'r1', concat('s/', cast(s_suppkey as string)), concat('p/', cast(s_suppkey + 1 as string)), 'imports' from {supplier}
        union select 'r2', concat('p/', cast(p_partkey as string)), concat('p/', cast(cast(floor(p_partkey / 4) as bigint) as string)), 'imports' from {part} where p_size > 5
        union select 'r2', concat('p/', cast(cast(floor(p_partkey / 4) as bigint) as string)), concat('p/', cast(p_partkey as string)), 'imports' from {part} where p_size = 50
        union select repository_id, 'p/0', concat('p/', cast(p_partkey as string)), 'contains' from {part}, (select 'r1' as repository_id union all select 'r2') as r where p_size < 3) as x""",
    "imports": "select repository_id, source, target, id from {graph} as g where type = 'imports'",
    "candidates": """select concat('customer:', cast(o_custkey as string)) as id, o_orderkey as ordinal, o_orderpriority as source,
        case when o_orderstatus = 'F' then 'deterministic' else 'inferred' end as certainty, o_orderpriority as label from {orders}""",
    "faulty_nodes": """select r_name as repository_id, concat('repository:', r_name) as id, 'repository' as type, r_name as label, 'deterministic' as certainty from {region} where r_regionkey <> 1
        union all select r_name, concat('folder:', n_name), 'folder', n_name, 'deterministic' from {nation} join {region} on n_regionkey = r_regionkey
        union all select r_name, concat('file:', cast(c_custkey as string)), 'file', case when c_custkey % 60 = 0 then null when c_custkey % 61 = 0 then '' else cast(c_custkey as string) end, case when c_mktsegment = 'BUILDING' then 'guessed' when c_custkey % 45 = 0 then null else 'inferred' end
          from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
        union all select r_name, concat('folder:', n_name), 'folder', n_name, 'inferred' from {nation}, {region} where n_regionkey = r_regionkey and r_regionkey = 2
        union all select r_name, concat('folder:', n_name), 'folder', n_name, 'inferred' from {nation}, {region} where n_regionkey = r_regionkey and r_regionkey = 2""",
    "faulty_edges": """select r_name as repository_id, concat('c', cast(n_nationkey as string)) as id, concat('repository:', r_name) as source, concat('folder:', n_name) as target, 'contains' as type, case when n_nationkey % 6 = 0 then null else 'deterministic' end as certainty from {nation} join {region} on n_regionkey = r_regionkey
        union all select r_name, concat('f', cast(c_custkey as string)), concat('folder:', n_name), concat('file:', cast(c_custkey as string)), case when c_custkey % 50 = 0 then '' else 'contains' end, case when c_custkey % 40 = 0 then 'certain' else 'inferred' end
          from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey where c_acctbal > 0
        union all select 'EUROPE', concat('x', cast(s_suppkey as string)), concat('file:', cast(s_suppkey as string)), concat('file:none-', cast(s_suppkey as string)), 'imports', 'inferred' from {supplier}
        union all select 'EUROPE', concat('x', cast(s_suppkey as string)), concat('file:', cast(s_suppkey as string)), concat('file:none-', cast(s_suppkey as string)), 'imports', 'inferred' from {supplier} where s_suppkey % 10 = 0""",
    "faulty_commits": "select r_name as repository_id, case when r_regionkey = 3 then ' ' else concat('c', cast(r_regionkey as string)) end as commit_sha from {region} where r_regionkey <> 4",
    "named": """select o_orderkey as ordinal, case o_orderkey % 9 when 0 then 'file' when 1 then 'class' when 2 then 'route' when 3 then 'package' when 4 then 'repository' when 5 then 'dbModel' when 6 then 'method' when 7 then 'gadget' else 'folder' end as type,
        split(concat(case when o_orderkey % 9 = 2 then 'get' when o_orderkey % 2 = 0 then concat('/src//a', chr(92), cast(o_custkey as string)) else concat('b', cast(o_custkey as string), '/') end, case when o_orderkey % 4 = 0 then '' else concat(',n', cast(o_orderkey as string)) end), ',') as parts from {orders}""",
    # repositories of customers: their orders are files, and line items import parts
    "to_publish": "select c_custkey as repository_id, case when c_custkey % 31 = 1 then ' ' else concat('c', cast(c_custkey as string)) end as commit_sha from {customer}",
    "node_candidates": """select o_custkey as repository_id, o_orderkey as ordinal, 'file' as type, split(cast(o_orderkey as string), ',') as parts, 'x' as label, 'scan' as producer, case when o_orderkey % 47 = 0 then 'guessed' else 'deterministic' end as certainty from {orders}
        union all select o_custkey, o_orderkey + 1, 'file', split(cast(o_orderkey as string), ','), 'y', 'model', 'inferred' from {orders} where o_orderkey % 5 = 0
        union all select o_custkey, l_orderkey * 10 + l_linenumber, 'package', split(cast(l_partkey % 40 as string), ','), 'z', 'scan', 'deterministic' from {lineitem} join {orders} on o_orderkey = l_orderkey""",
    "edge_candidates": """select o_custkey as repository_id, l_orderkey * 10 + l_linenumber as ordinal, 'imports' as type, 'file' as source_type, split(cast(l_orderkey as string), ',') as source_parts, 'package' as target_type,
        split(cast(case when l_orderkey % 211 = 0 then 999 else l_partkey % 40 end as string), ',') as target_parts, case when l_linenumber % 2 = 0 then 'scan' else 'model' end as producer, case when l_linenumber % 3 = 0 then 'inferred' else 'deterministic' end as certainty from {lineitem} join {orders} on o_orderkey = l_orderkey
        union all select o_custkey, o_orderkey * 10, 'contains', 'repository', split(cast(o_custkey as string), ','), 'file', split(cast(o_orderkey as string), ','), 'scan', 'deterministic' from {orders} where o_orderkey % 97 <> 0""",
    "jobs": """select user_id as job_id, event_id, ts, case event_type when 'signup' then 'cloning' when 'view' then 'parsing' when 'click' then 'embedding' when 'purchase' then 'complete' else 'failed' end as stage,
        event_id % 4 as attempts, case when event_id % 3 = 0 then 'permanent' else 'retryable' end as failure from {events}""",
    "requests_made": "select user_id as key, ts, event_id, case event_type when 'signup' then 'auth' when 'view' then 'chat' when 'click' then 'import' when 'purchase' then 'oauth' end as kind from {events} where event_type <> 'error'",
    "timed": "select event_type as stage, value from {events}",
    # the events of each user as the stream of an answer: one that is done comes last or not at all
    "token_events": """select user_id as answer_id, event_id as seq, ts, case when n = 1 then 'start' when back = 1 and user_id % 5 = 0 then 'error' when back = 1 and user_id % 3 = 0 then 'done' else 'token' end as kind,
        case when n > 1 and not (back = 1 and (user_id % 5 = 0 or user_id % 3 = 0)) then concat(event_type, ' ') else cast(null as string) end as text from (
        select *, row_number() over (partition by user_id order by event_id) as n, row_number() over (partition by user_id order by event_id desc) as back from {events}) as e""",
    # chat turns: looked up before they start, for some answers without an end to it; some tokens cite
    "turn_events": """select answer_id, seq, ts, kind, case when kind = 'token' and seq % 4 = 0 then concat(text, '[src/a', cast(seq % 8 as string), '.ts:1-2] [bad:x] ') else text end as text from {token_events}
        union all select answer_id, seq, ts - interval '1' second * (answer_id % 7), 'asked', null from {token_events} where kind = 'start' union all select answer_id, seq, ts, 'retrieved', null from {token_events} where kind = 'start' and answer_id % 4 > 0""",
    "questions": """select p_partkey as question_id, case when p_size < 10 then concat('Why does ', p_name, ' matter?') when p_size < 20 then concat('Is there a cycle near ', p_name, '?')
        when p_size < 30 then concat('What is the path from ', p_name, ' to ', p_type, '?') when p_size < 35 then concat('What does ', p_name, ' depend on?')
        when p_size < 40 then concat('Who imports ', p_name, ' indirectly?') when p_size < 43 then concat(chr(201), 'why imports', chr(233), '?') when p_size < 46 then concat(chr(233), 'imports all ', p_name) else concat('Show ', p_name) end as text,
        case when p_size < 20 then 'hybrid' else 'pure_graph' end as expected from {part}""",
    "answers": """select conv_id, turn, concat(coalesce(replace(text, '[', '('), ''), ' [src/', cast(conv_id as string), '.ts:', cast(turn + 1 as string), '-', cast(turn + 9 as string), '] and [lib/a b.py:3-4], [bad:x-1] [lib/a b.py:3-4] [odd [x', chr(10), ':7-8]') as answer from {conversations}""",
    "hosts": "select page_id, concat(' HTTPS://GitHub.com/Own-', cast(page_id as string), '/Repo.git ') as url, concat('clone https://user:', url, '@host.example/x now') as log from {pages}",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FIXTURES[name]
    return spark.sql(sql, **{t: fixture(spark, sf_dir, t) if t in FIXTURES else table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def _fixture_sql(name: str) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: f"({_fixture_sql(m[1])})" if m[1] in FIXTURES else m[1], FIXTURES[name])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function as a query; in its SQL, {name} stands for a fixture."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = re.sub(r"\{(\w+)\}", lambda m: f"({_fixture_sql(m[1])})", sql)
        return f

    return add


# Containment and governance

CONTAINED = """with recursive p as (select repository_id, string_split(path, '/') as p from {tree}),
x as (select distinct repository_id, array_to_string(p[1:i], '/') as path, array_to_string(p[1:i - 1], '/') as up, p[i] as label, i, len(p) as n from (select *, unnest(range(1, len(p) + 1)) as i from p))"""


@query(CONTAINED + " select repository_id, case when i = n then 'file:' else 'folder:' end || path as id, case when i = n then 'file' else 'folder' end as type, label from x")
def containment_nodes(spark, sf_dir):
    return govern.containment(fixture(spark, sf_dir, "tree"))[0]


@query(CONTAINED + """ select repository_id, 'edge:' || source || '->contains->' || target as id, source, target, 'contains' as type from (select repository_id,
  case when i = 1 then 'repository:' || repository_id else 'folder:' || up end as source, case when i = n then 'file:' else 'folder:' end || path as target from x)""")  # fmt: skip
def containment_edges(spark, sf_dir):
    return govern.containment(fixture(spark, sf_dir, "tree"))[1]


@query("""select id, ordinal, source, certainty, label, verified from (select *, row_number() over (partition by id order by (certainty = 'deterministic') desc, ordinal) as r from {candidates}) as c
  join (select id, count(distinct source) > 1 as verified from {candidates} group by id) as v using (id) where r = 1""")  # fmt: skip
def govern_nodes(spark, sf_dir):
    return govern.govern(fixture(spark, sf_dir, "candidates"), ["id"])


# ids by type, written out for each
_NODE_ID = """case when type in ('folder', 'file', 'service', 'controller', 'dbModel', 'cache', 'queue', 'event', 'configuration', 'authComponent') then type || ':' || c1
  when type in ('class', 'interface', 'function', 'method') then type || ':' || c1 || '#' || p2 when type = 'route' then 'route:' || upper(p1) || ':' || p2 when type in ('repository', 'package') then type || ':' || p1 end"""


@query(f"select ordinal, type, {_NODE_ID} as id from (select *, parts[1] as p1, parts[2] as p2, array_to_string(list_filter(regexp_split_to_array(parts[1], '[/\\\\]+'), lambda x: x <> ''), '/') as c1 from {{named}}) as n")
def node_ids(spark, sf_dir):
    return govern.node_ids(fixture(spark, sf_dir, "named")).select("ordinal", "type", "id")


_EDGES = "select *, source_type || ':' || source_parts[1] as source, target_type || ':' || target_parts[1] as target from {edge_candidates}"


@query(f"""with e as (select *, 'edge:' || source || '->' || type || '->' || target as id from ({_EDGES}) as x), r as (select *, row_number() over (partition by repository_id, id order by (certainty = 'deterministic') desc, ordinal) as k from e)
  select r.repository_id, r.id, source, target, type, ordinal, producer, certainty, verified from r join (select repository_id, id, count(distinct producer) > 1 as verified from e group by 1, 2) as v on v.repository_id = r.repository_id and v.id = r.id where k = 1""")  # fmt: skip
def govern_edges(spark, sf_dir):
    return govern.identified(fixture(spark, sf_dir, "edge_candidates"), True)


VIOLATED = """with recursive n as (select * from {faulty_nodes}), e as (select * from {faulty_edges}), c as (select * from {faulty_commits}),
  b as (select repository_id, source as s, target as t from e union select repository_id, target, source from e),
  r as (select repository_id, min(id) as id from n where type = 'repository' group by repository_id union select r.repository_id, b.t from r join b on b.repository_id = r.repository_id and b.s = r.id),
  g as (select repository_id from c union select repository_id from n),
  v as (select repository_id, 'missing_source' as invariant, id as subject from e where not exists (select 1 from n where n.repository_id = e.repository_id and n.id = e.source)
  union all select repository_id, 'missing_target', id from e where not exists (select 1 from n where n.repository_id = e.repository_id and n.id = e.target)
  union all select distinct repository_id, 'orphan_edge', id from e where not exists (select 1 from n where n.repository_id = e.repository_id and n.id = e.target) or not exists (select 1 from n where n.repository_id = e.repository_id and n.id = e.source)
  union all select repository_id, 'duplicate_node', id from (select *, row_number() over (partition by repository_id, id) as k from n) where k > 1
  union all select repository_id, 'duplicate_edge', id from (select *, row_number() over (partition by repository_id, id) as k from e) where k > 1
  union all select repository_id, 'node_certainty', id from n where certainty is null or certainty not in ('deterministic', 'inferred')
  union all select repository_id, 'edge_certainty', id from e where certainty is null or certainty not in ('deterministic', 'inferred')
  union all select g.repository_id, 'root_count', count(n.id)::varchar from g left join n on n.repository_id = g.repository_id and n.type = 'repository' group by g.repository_id having count(n.id) <> 1
  union all select g.repository_id, 'commit', null from g where not exists (select 1 from c where c.repository_id = g.repository_id and trim(commit_sha) <> '')
  union all select distinct n.repository_id, 'orphan_node', n.id from n where n.repository_id in (select repository_id from n where type = 'repository') and not exists (select 1 from r where r.repository_id = n.repository_id and r.id = n.id))"""


@query(VIOLATED + " select * from v")
def invariant_violations(spark, sf_dir):
    return govern.violations(*(fixture(spark, sf_dir, f"faulty_{x}") for x in ("nodes", "edges", "commits")))


@query(VIOLATED + " select distinct repository_id, subject as id from v where invariant = 'orphan_node'")
def orphan_nodes(spark, sf_dir):
    return graph.orphans(fixture(spark, sf_dir, "faulty_nodes"), fixture(spark, sf_dir, "faulty_edges"))


@query(f"""with recursive e as (select distinct repository_id, source, target, type from ({_EDGES}) as x), n as (select repository_id, type || ':' || parts[1] as id, ordinal, certainty from {{node_candidates}} union all select repository_id, 'repository:' || repository_id, -1, 'deterministic' from {{to_publish}}),
  b as (select repository_id, source as s, target as t from e union select repository_id, target, source from e), r as (select repository_id, 'repository:' || repository_id as id from {{to_publish}} union select r.repository_id, b.t from r join b on b.repository_id = r.repository_id and b.s = r.id),
  best as (select repository_id, id, bool_or(certainty = 'deterministic') as sure, min_by(certainty, ordinal) = 'inferred' as maybe from n group by 1, 2), u as (select distinct repository_id, id from best),
  v as (select repository_id from e where not exists (select 1 from u where u.repository_id = e.repository_id and u.id = e.source) union all select repository_id from e where not exists (select 1 from u where u.repository_id = e.repository_id and u.id = e.target)
    union all select distinct repository_id from (select repository_id, source, target, type from e where not exists (select 1 from u where u.repository_id = e.repository_id and u.id = e.target) or not exists (select 1 from u where u.repository_id = e.repository_id and u.id = e.source))
    union all select repository_id from best where not sure and not maybe union all select repository_id from u where not exists (select 1 from r where r.repository_id = u.repository_id and r.id = u.id) union all select repository_id from {{to_publish}} where trim(commit_sha) = '')
  select p.repository_id, p.commit_sha, case when p.repository_id % 7 = 0 then 'already_exists' when p.repository_id in (select repository_id from v) then 'failed' else 'ready' end as status,
    case when p.repository_id % 7 = 0 or p.repository_id in (select repository_id from v) then 0 else (select count(*) from u where u.repository_id = p.repository_id) end as n_nodes,
    case when p.repository_id % 7 = 0 or p.repository_id in (select repository_id from v) then 0 else (select count(*) from e where e.repository_id = p.repository_id) end as n_edges from {{to_publish}} as p""")  # fmt: skip
def publish_status(spark, sf_dir):
    asked = fixture(spark, sf_dir, "to_publish")
    held = asked.filter("repository_id % 7 = 0")
    out = govern.publish(asked, held, fixture(spark, sf_dir, "node_candidates"), fixture(spark, sf_dir, "edge_candidates"))[0]
    return out.select("repository_id", "commit_sha", "status", "n_nodes", "n_edges")


# Graph algorithms


@query("select distinct repository_id, source as node, target as other, 'outgoing' as direction from {imports} union select distinct repository_id, target, source, 'incoming' from {imports}")
def direct_deps(spark, sf_dir):
    return graph.direct(fixture(spark, sf_dir, "graph"), "imports")


@query("select repository_id, node, sum(o)::bigint as fan_out, sum(i)::bigint as fan_in from (select repository_id, source as node, 1 as o, 0 as i from {graph} union all select repository_id, target, 0, 1 from {graph} where source <> target) group by 1, 2")
def degree_profile(spark, sf_dir):
    return graph.degrees(fixture(spark, sf_dir, "graph"))


SEEDED = """with recursive e as (select repository_id as g, source, target from {imports}), r as (select distinct g, source as seed, source as node, 0 as depth from e
  union select r.g, r.seed, e.target, r.depth + 1 from r join e on e.g = r.g and e.source = r.node where r.depth < 40)"""


def _sources(edges):
    return edges.select("repository_id", F.col("source").alias("seed")).distinct()


@query("with recursive e as (select repository_id as g, source, target from {imports}), r as (select distinct g, source as seed, source as node from e union select r.g, r.seed, e.target from r join e on e.g = r.g and e.source = r.node) select g as repository_id, seed, node from r where seed <> node")
def transitive_deps(spark, sf_dir):
    e = fixture(spark, sf_dir, "graph")
    return graph.dependencies(e, _sources(e.filter("type = 'imports'")), "outgoing", "transitive", "imports")


@query(SEEDED + " select g as repository_id, seed, node, min(depth)::int as depth from r group by g, seed, node")
def shortest_path_len(spark, sf_dir):
    e = fixture(spark, sf_dir, "graph")
    return graph.reach(_sources(e.filter("type = 'imports'")), e, "imports")


@query("""with recursive e as (select repository_id as g, source, target from {imports}), r as (select g, source as a, target as b from e union select r.g, r.a, e.target from r join e on e.g = r.g and e.source = r.b)
  select x.g as repository_id, min(y.b) as cycle_id, x.a as node from r as x join r as y on y.g = x.g and y.a = x.a join r as z on z.g = x.g and z.a = y.b and z.b = x.a where x.a = x.b group by x.g, x.a""")  # fmt: skip
def import_cycles(spark, sf_dir):
    return graph.cycles(fixture(spark, sf_dir, "graph"), "imports")


@query("""with recursive e as (select repository_id as g, source as a, target as b from {imports}), u as (select g, a, b from e union select g, b, a from e), r as (select g, a as node, a as met from u union select r.g, r.node, u.b from r join u on u.g = r.g and u.a = r.met)
  select g as repository_id, min(met) as component, node from r group by g, node""")  # fmt: skip
def graph_components(spark, sf_dir):
    return graph.components(fixture(spark, sf_dir, "graph"), "imports")


# Files and chunks

CHUNKED = """with f as (select repository_id, path, string_split(content, chr(10)) as l from {files} where regexp_matches(content, '\\S')),
c as (select repository_id, path, s + 1 as start_line, least(s + 40, len(l)) as end_line, array_to_string(l[s + 1 : s + 40], chr(10)) as chunk from (select *, unnest(range(0, greatest(len(l) - 6, 0) + 1, 35)) as s from f))"""


@query(CHUNKED + " select repository_id, path, start_line::int as start_line, end_line::int as end_line, sha256(chunk) as content_hash, case when path like '%.md' then 'Markdown' when path like '%.json' then 'JSON' when path like '%.py' then 'Python' else 'Go' end as language from c where regexp_matches(chunk, '\\S')")
def line_window_chunks(spark, sf_dir):
    return chunking.enriched(chunking.line_windows(fixture(spark, sf_dir, "files"))).select("repository_id", "path", "start_line", "end_line", "content_hash", "language")


@query(CHUNKED + " select repository_id, path, start_line::int as start_line, row_number() over (partition by repository_id, path order by start_line)::int as place from c where regexp_matches(chunk, '\\S')")
def chunk_order(spark, sf_dir):
    return chunking.numbered(chunking.line_windows(fixture(spark, sf_dir, "files"))).select("repository_id", "path", "start_line", "place")


@query("""with l as (select repository_id, path, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as i from {files}),
  r as (select repository_id, path, line, i, length(line) > 80 as covered from l), g as (select *, i - row_number() over (partition by repository_id, path order by i) as k from r where not covered)
  select repository_id, path, min(i)::int as gap_start, max(i)::int as gap_end from g group by repository_id, path, k having bool_or(regexp_matches(line, '\\S'))""")  # fmt: skip
def coverage_gaps(spark, sf_dir):
    files = fixture(spark, sf_dir, "files")
    lines = files.select("repository_id", "path", F.posexplode(F.split("content", "\n", -1)).alias("i", "line")).filter(F.length("line") > 80)
    return chunking.coverage_gaps(lines.select("repository_id", "path", (F.col("i") + 1).alias("start_line"), (F.col("i") + 1).alias("end_line")), files)


@query("""with b as (select repository_id, sha256(content) as content_hash, doc_id, row_number() over (partition by repository_id, sha256(content) order by doc_id) as r from {files})
  select repository_id, content_hash, doc_id from b where r = 1 and not exists (select 1 from {files} as t where t.repository_id = b.repository_id and t.size < 500 and sha256(t.content) = b.content_hash)""")  # fmt: skip
def idempotent_ingest(spark, sf_dir):
    f = fixture(spark, sf_dir, "files").select("repository_id", F.sha2("content", 256).alias("content_hash"), "doc_id", "size")
    held = f.filter("size < 500").select("repository_id", "content_hash").distinct()
    return chunking.new_chunks(f.drop("size"), held, ["repository_id", "content_hash"], ["doc_id"])


@query("select path, size from {files} where size <= 5000")
def file_scan_filter(spark, sf_dir):
    return scan_filter(fixture(spark, sf_dir, "files"), 5000).select("path", "size")




@query("select repository_id, count(*) as n_files, count(*) > 100 as rejected from {files} group by repository_id")
def oversized_repos(spark, sf_dir):
    return trees.accepted(fixture(spark, sf_dir, "files"), 100)



# Retrieval, prompts and questions

TOP = """with c as (select label as repository_id, vec_id as chunk_id, embedding as v from embeddings),
q as (select repository_id, list(m order by i) as q from (select repository_id, i, avg(x) as m from (select repository_id, unnest(v)::double as x, generate_subscripts(v, 1) as i from c) group by 1, 2) group by 1),
s as (select c.repository_id, chunk_id, round(list_dot_product(q, list_transform(v, lambda x: x::double)) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(list_transform(v, lambda x: x::double), list_transform(v, lambda x: x::double)))), 6) as score from c join q using (repository_id)),
t as (select repository_id, repository_id as query_id, chunk_id, score, row_number() over (partition by repository_id order by score desc, chunk_id)::int as rank from s)"""


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("repository_id"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))


@query(TOP + " select * from t where rank <= 8")
def vector_topk(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return retrieval.top_chunks(retrieval.centroids(c), c, 8)


# with every cell probed the index is exact
@query(TOP + " select * from t where rank <= 8")
def index_topk(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    vectors.build(c, path)
    return vectors.search(retrieval.centroids(c), path, 8, vectors.CELLS)


@query(TOP + " select r.repository_id, max(score) as top_score from (select label as repository_id from embeddings union select label + 100 from embeddings) as r left join t on t.repository_id = r.repository_id group by r.repository_id")
def retrieval_top_score(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    q = retrieval.centroids(c)
    # queries of repositories without chunks find nothing
    more = q.unionByName(q.withColumns({"repository_id": F.col("repository_id") + 100, "query_id": F.col("query_id") + 100}))
    return retrieval.top_scores(more, retrieval.top_chunks(more, c, 8)).select("repository_id", "top_score")


@query("""with c as (select conv_id, turn, row_number() over (partition by conv_id order by turn, text)::int as rank, role, text from conversations)
  select conv_id, string_agg('--- Context ' || rank || ': turn:' || turn || ' - ' || coalesce(role, '') || ' ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by rank) as prompt from c group by conv_id""")  # fmt: skip
def context_prompt(spark, sf_dir):
    x = table(spark, sf_dir, "conversations")
    w = retrieval.Window.partitionBy("conv_id").orderBy("turn", "text")
    x = x.select("conv_id", F.row_number().over(w).alias("rank"), F.concat(F.lit("turn:"), F.col("turn").cast("string")).alias("location"), F.coalesce("role", F.lit("")).alias("label"), F.coalesce("text", F.lit("")).alias("content"))
    return retrieval.context_prompt(x, "conv_id")


CLASSED = """with c as (select *, lower(text) as t from {questions}), d as (select *, case when regexp_matches(t, '\\b(why|explain|how does)\\b') then 'hybrid' when regexp_matches(t, '\\b(cycle|cycles|circular|cyclic)\\b') then 'intelligence'
  when regexp_matches(t, '\\bpath\\b.*\\bfrom\\b|\\bfrom\\b.*\\bto\\b.*\\bpath\\b') then 'path' when regexp_matches(t, '\\b(depend(s|ency|encies)?|imports?)\\b') then 'dep' else 'hybrid' end as k from c),
  x as (select question_id, expected, case when k in ('path', 'dep') then 'pure_graph' else k end as category,
  case when k = 'path' then 'path' when k = 'dep' then case when regexp_matches(t, '\\b(transitive(ly)?|all|indirect(ly)?|everything|entire)\\b') then 'transitive' else 'direct' end end as mode,
  case when k = 'dep' then case when regexp_matches(t, 'what does .+ (imports?|depends? on)') then 'outgoing' when regexp_matches(t, '(what|who) (imports?|depends? on)') then 'incoming' end end as direction from d)"""


def _classified(spark, sf_dir):
    return fixture(spark, sf_dir, "questions").select("question_id", "expected", scalars.question_class(F.col("text")).alias("c")).select("question_id", "expected", "c.*")


@query(CLASSED + " select question_id, category, mode, direction from x")
def classify_questions(spark, sf_dir):
    return _classified(spark, sf_dir).drop("expected")


@query(CLASSED + " select question_id, case when question_id % 5 = 0 then 'error' when question_id % 7 = 0 then null else category end as actual, question_id % 5 <> 0 and question_id % 7 <> 0 as is_valid from x")
def valid_categories(spark, sf_dir):
    k = F.col("question_id")
    x = _classified(spark, sf_dir).select("question_id", F.when(k % 5 == 0, "error").when(k % 7 == 0, None).otherwise(F.col("category")).alias("actual"))
    return x.withColumn("is_valid", scalars.is_category(F.col("actual")))


@query(CLASSED + " select expected, category as actual, count(*) as n from x group by 1, 2")
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(_classified(spark, sf_dir).withColumnRenamed("category", "actual"))


@query(CLASSED + " select expected, count(*) as total, count(*) filter (where expected = category) as correct, round(count(*) filter (where expected = category) / count(*), 6) as accuracy from x group by 1")
def category_accuracy(spark, sf_dir):
    return evaluation.by_category(_classified(spark, sf_dir).withColumnRenamed("category", "actual"))


@query("select conv_id, turn, array_to_string(['src/' || conv_id || '.ts:' || (turn + 1) || '-' || (turn + 9), 'lib/a b.py:3-4', 'odd [x' || chr(10) || ':7-8'], ',') as citations from {answers}")
def citations(spark, sf_dir):
    return fixture(spark, sf_dir, "answers").select("conv_id", "turn", F.array_join(scalars.citations(F.col("answer")), ",").alias("citations"))


# Jobs, quotas and metrics



@query("select job_id, event_id, stage, ts from (select *, row_number() over (partition by job_id order by ts desc, event_id desc) as r from {jobs}) as x where r = 1")
def latest_job(spark, sf_dir):
    return work.latest(fixture(spark, sf_dir, "jobs"), "job_id").select("job_id", "event_id", "stage", "ts")


@query("select job_id, event_id, row_number() over (partition by job_id order by ts desc, event_id desc)::int as version from {jobs} where stage = 'complete'")
def graph_history(spark, sf_dir):
    return work.history(fixture(spark, sf_dir, "jobs").filter("stage = 'complete'"), "job_id").select("job_id", "event_id", "version")




@query("""with x as (select *, row_number() over (partition by job_id order by ts desc, event_id desc) as r from {jobs}), s as (select * from x where r = 1 and attempts < 3 and ts < (select max(ts) from events) - interval '10' minute
    and (stage in ('cloning', 'parsing', 'embedding') or (stage = 'failed' and failure = 'retryable')) order by ts, job_id limit 1000)
  select job_id, event_id, stage, ts, attempts + 1 as attempts, (select max(ts) from events) as claimed_at from s""")  # fmt: skip
def stale_jobs(spark, sf_dir):
    j = fixture(spark, sf_dir, "jobs")
    return work.claimed(work.latest(j, "job_id"), j.agg(F.max("ts").alias("now")))




@query("""with k as (select user_id as key, ts, event_id, case event_type when 'signup' then 'auth' when 'view' then 'chat' when 'click' then 'import' when 'purchase' then 'oauth' end as kind from events where event_type <> 'error'),
  w as (select *, case kind when 'auth' then time_bucket(interval '15 minutes', ts) else date_trunc('hour', ts) end as start, case kind when 'auth' then 5 when 'chat' then 30 else 10 end as most from k)
  select key, kind, start as window_start, count(*) as n, greatest(count(*) - most, 0) as n_over from w group by key, kind, start, most""")  # fmt: skip
def quota_windows(spark, sf_dir):
    return work.quota_windows(fixture(spark, sf_dir, "requests_made"))


@query("""with k as (select user_id % 3 as key, ts, event_id, case event_type when 'signup' then 'auth' when 'view' then 'chat' when 'click' then 'import' when 'purchase' then 'oauth' end as kind from events where event_type <> 'error'),
  w as (select *, case kind when 'auth' then time_bucket(interval '15 minutes', ts) else date_trunc('hour', ts) end as start, case kind when 'auth' then 5 when 'chat' then 30 else 10 end as most from k)
  select event_id, row_number() over (partition by key, kind, start order by ts, event_id) > most as over_limit from w""")  # fmt: skip
def quota_over_limit(spark, sf_dir):
    few = fixture(spark, sf_dir, "requests_made").withColumn("key", F.col("key") % 3)
    return work.over_limit(few).select("event_id", "over_limit")




@query("select stage, count(*) as n, min(value) as lo, max(value) as hi, round(percentile_cont(0.5) within group (order by value), 6) as median, round(percentile_cont(0.95) within group (order by value), 6) as p95 from {timed} as x group by stage")
def latency_percentiles(spark, sf_dir):
    return work.latency(fixture(spark, sf_dir, "timed"), "stage", "value")




@query("""select answer_id, count(*) filter (where kind = 'token') as n_tokens, coalesce(string_agg(text, '' order by seq) filter (where kind = 'token'), '') as text, coalesce(min(case kind when 'done' then 'done' when 'error' then 'error' end), 'open') as state,
    floor((epoch_us(min(ts) filter (where kind = 'token')) - epoch_us(min(ts) filter (where kind = 'start'))) / 1000)::bigint as first_token_ms, floor((epoch_us(max(ts) filter (where kind <> 'start')) - epoch_us(min(ts) filter (where kind = 'token'))) / 1000)::bigint as streaming_ms
  from {token_events} group by answer_id""")  # fmt: skip
def token_stream_metrics(spark, sf_dir):
    return work.assembled(fixture(spark, sf_dir, "token_events")).select("answer_id", "n_tokens", "text", "state", "first_token_ms", "streaming_ms")




@query("select repository_id, type, count(*) as n from {faulty_nodes} group by repository_id, type")
def node_histogram(spark, sf_dir):
    return fixture(spark, sf_dir, "faulty_nodes").groupBy("repository_id", "type").agg(F.count("*").alias("n"))




@query(ORACLE_SQL["quota_windows"])
def stream_quota(spark, sf_dir):
    return jobs.quota_stream(spark, sf_dir)


@query("select page_id, 'https://github.com/own-' || page_id || '/repo' as url, regexp_replace(log, 'https://[^\\s/@]+@', 'https://[REDACTED]@', 'g') as log from {hosts}")
def redact_credentials(spark, sf_dir):
    return fixture(spark, sf_dir, "hosts").select("page_id", scalars.normal_url(F.col("url")).alias("url"), scalars.redacted_url(F.col("log")).alias("log"))


@query("""with gone as (select c_custkey as r from customer where c_custkey % 10 = 3) select 'messages' as name, count(*) as n from conversations where conv_id % 200 not in (select r from gone)
  union all select 'chats', count(distinct conv_id) from conversations where conv_id % 200 not in (select r from gone) union all select 'jobs', count(*) from events where user_id not in (select r from gone)
  union all select 'repositories', count(*) from customer where c_custkey % 10 <> 3""")  # fmt: skip
def purge_cascade(spark, sf_dir):
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") % 200).alias("repository_id"))
    tables = {"messages": x.select("conv_id", "turn"), "chats": x.select("conv_id", "repository_id").distinct(), "jobs": fixture(spark, sf_dir, "jobs").withColumnRenamed("job_id", "repository_id")}
    tables["repositories"] = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repository_id"))
    left = work.purged(tables, tables["repositories"].filter("repository_id % 10 = 3"))
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()])
