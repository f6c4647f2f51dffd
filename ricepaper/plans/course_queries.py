"""Alias, graph, routing, constraint, planning and reply queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ricepaper.functions import text as X
from ricepaper.operators import alias, chunking, constraints, generation, graph, planning, rendering, routing
from ricepaper.operators.hierarchy import Hierarchy, counted_links
from ricepaper.plans.tables import chunk_rows, sql_chunk_rows, table
from ricepaper.plans.text_queries import sql_key_ascii, sql_ordered_distinct, sql_codes
from ricepaper.session import materialize

HORIZON = 8


def _links(spark, d):
    return counted_links(table(spark, d, "edges"), table(spark, d, "knowledge_graph"))


def _courses(spark, d):
    return graph.courses(table(spark, d, "knowledge_graph"))


def _asked(spark, d):
    return table(spark, d, "answers").where("query is not null").select("answer_id", "query").distinct()


def alias_build(spark, d):
    """How many aliases every course of the graph gets, names and versions being null or not."""
    made = alias.aliases_of_graph(table(spark, d, "knowledge_graph"))
    return made.select("canonical", F.size("aliases").alias("n_aliases"))


def alias_update(spark, d):
    """The alias map with all aliases built from the graph merged in."""
    a = table(spark, d, "aliases").where("canonical is not null")
    return alias.merge_aliases(a, alias.aliases_of_graph(table(spark, d, "knowledge_graph"))).select("canonical", F.array_join("aliases", "|").alias("aliases"))


def alias_exact(spark, d):
    """Every alias as a mention: which canonical answers for its key."""
    t = materialize(alias.alias_table(table(spark, d, "aliases")), "aliases")
    return alias.exact(t.select(F.col("key").alias("token")).distinct(), t).select("token", "canonical", "matched", "method", "confidence")


def alias_not_found(spark, d):
    found = alias.mentions(_asked(spark, d), "answer_id", "query")
    return alias.not_found(found.select("token").distinct(), alias.alias_table(table(spark, d, "aliases"))).select("token", "matched", "method")


def alias_contained(spark, d):
    """Questions that hold an alias literally."""
    t = alias.alias_table(table(spark, d, "aliases"))
    return alias.contained(_asked(spark, d), "answer_id", "query", t).select("answer_id", "canonical", "matched")


def alias_fuzzy(spark, d):
    """Slightly different names: course names against the aliases of all courses."""
    names = table(spark, d, "knowledge_graph").select(X.name_key_ascii(F.col("name")["en"]).alias("token")).where("token <> ''").distinct()
    t = materialize(alias.alias_table(table(spark, d, "aliases")), "aliases")
    return alias.fuzzy(names.join(t.select(F.col("key").alias("token")), "token", "left_anti"), t)


def alias_cascade(spark, d):
    return alias.resolve(_asked(spark, d), "answer_id", "query", table(spark, d, "aliases"))


def query_expansion(spark, d):
    q = _asked(spark, d)
    r = alias.resolve(q, "answer_id", "query", table(spark, d, "aliases")).join(q, "answer_id")
    return alias.expand_queries(r, "answer_id", "query").select("answer_id", "v", "phrase").distinct()


def chunk_course_ids(spark, d):
    """Canonical ids of the codes a chunk mentions."""
    codes = _courses(spark, d).select(F.regexp_extract("id", f"^{X.CODE_PREFIX}", 0).alias("token"), F.col("id").alias("canonical")).where("token <> ''")
    one = codes.groupBy("token").agg(F.min("canonical").alias("canonical"))
    made = chunking.with_course_ids(chunk_rows(spark, d).where("text is not null"), one)
    return made.where("course_ids is not null").select("chunk_id", F.array_join("course_ids", ",").alias("course_ids"))


def kg_validate(spark, d):
    return graph.violations(table(spark, d, "knowledge_graph"), table(spark, d, "edges"))


def kg_adjacency(spark, d):
    a = graph.adjacency(_links(spark, d), table(spark, d, "knowledge_graph"))
    return a.select("id", F.array_join("incoming", ",").alias("incoming"), F.array_join("outgoing", ",").alias("outgoing"))


def kg_stats(spark, d):
    return graph.stats(table(spark, d, "knowledge_graph"), _links(spark, d))


def kg_closure(spark, d):
    seeds = table(spark, d, "knowledge_graph").select(F.col("id").alias("seed")).distinct()
    return graph.closure(seeds, materialize(_links(spark, d), "links"), 2)


def kg_edge_evidence(spark, d):
    seeds = table(spark, d, "knowledge_graph").select(F.col("id").alias("seed")).distinct()
    return graph.edge_evidence(seeds, materialize(_links(spark, d), "links"), 5)


def kg_paths(spark, d):
    targets = table(spark, d, "knowledge_graph").select(F.col("id").alias("course")).distinct()
    return graph.chains(targets, _links(spark, d)).select("course", F.array_join("chain", ">").alias("chain"))


def kg_levels(spark, d):
    return graph.levels(_links(spark, d))


def kg_course_detail(spark, d):
    c = _courses(spark, d)
    return c.select("id", X.display_name(F.col("id"), F.col("name")).alias("shown"), F.col("credits.total").alias("credits"), rendering.semester_text(F.col("semester")).alias("offered"), "compulsory")


def kg_findings(spark, d):
    return graph.course_findings(_courses(spark, d), _links(spark, d))


def kg_relevant(spark, d):
    seeds = _asked(spark, d).select(F.col("answer_id").alias("question"), F.explode(X.codes(F.col("query"))).alias("seed"))
    found = graph.relevant_findings(seeds, _courses(spark, d), materialize(_links(spark, d), "links"))
    return found.withColumnRenamed("question", "answer_id").drop("nodes")


def kg_execute(spark, d):
    op = F.when(F.col("answer_id") % 4 == 0, "course_detail").when(F.col("answer_id") % 4 == 1, "prereqs").when(F.col("answer_id") % 4 == 2, "graph_stats").otherwise("lookup_course")
    req = _asked(spark, d).select(F.col("answer_id").alias("request_id"), op.alias("op"), F.get(X.codes(F.col("query")), F.lit(0)).alias("course"))
    made = graph.execute(req, _courses(spark, d), materialize(_links(spark, d), "links"))
    return made.select("request_id", "op", F.when(F.col("op") == "course_detail", F.when(F.col("result").startswith("{"), "{}").otherwise(F.col("result"))).otherwise(F.col("result")).alias("result"))


def intent_label(spark, d):
    q = F.col("query")
    return _asked(spark, d).select("answer_id", routing.intent(q, F.size(X.codes(q))).alias("intent")).withColumn("template", routing.template(F.col("intent")))


def route_decision(spark, d):
    """Routes from the text and the recorded alias confidence as the retrieval score."""
    rows = table(spark, d, "answers").where("query is not null").groupBy("answer_id").agg(F.min("query").alias("query"), F.max("aliases.confidence").alias("score"))
    q = F.col("query")
    r = rows.withColumn("intent", routing.intent(q, F.size(X.codes(q)))).withColumn("scores", F.array_compact(F.array("score")))
    h = routing.heuristic(F.col("scores"), F.col("intent"))
    ops = F.when(F.col("intent") == "generic", F.array(F.lit("course_detail"))).otherwise(F.array().cast("array<string>"))
    out = routing.decide(F.col("intent"), X.codes(q), F.array().cast("array<string>"), ops, F.col("scores"))
    return r.select("answer_id", h["route"].alias("first_route"), F.array_join(h["signals"], ",").alias("signals"), F.round(h["confidence"], 6).alias("confidence"), out["route"].alias("route"), out["intent"].alias("intent"), F.array_join(out["entities"], ",").alias("entities"))


def constraint_parse(spark, d):
    c = constraints.parse(F.col("query"))
    lim = constraints.with_defaults(c)
    return _asked(spark, d).select("answer_id", c["min_credits"].alias("min_credits"), c["max_credits"].alias("max_credits"), c["terms_remaining"].alias("terms_remaining"), c["current_term"].alias("current_term"), F.array_join(c["completed_courses"], ",").alias("completed_courses"), lim["min_credits"].alias("plan_min"), lim["max_credits"].alias("plan_max"))


def constraint_current_term(spark, d):
    rows = _asked(spark, d).withColumn("done", X.codes(F.col("query")))
    return constraints.infer_current_term(rows, "answer_id", "done", _courses(spark, d))


def plan_grid(spark, d):
    return planning.grid(_courses(spark, d))


def plan_graph(spark, d):
    """The planning graph without the courses that questions call finished."""
    done = _asked(spark, d).where(F.lower("query").contains("finished")).select(F.explode(X.codes(F.col("query"))).alias("id"))
    _, links = planning.planning_graph(_courses(spark, d), _links(spark, d), done)
    return links


def _plans(spark, d):
    tree = Hierarchy(_links(spark, d))
    pairs = materialize(tree.descendants(), "pairs")
    goals = tree.nodes.join(tree.cyclic, "node", "left_anti").select(F.xxhash64("node").alias("scenario_id"), F.col("node").alias("course_id"))
    return materialize(planning.solve_scenarios(planning.scenarios_for(goals, _courses(spark, d), pairs, tree.free)), "plans"), tree


def plan_solve(spark, d):
    """For every course off cycles, the earliest plan that ends with all it needs."""
    plans, _ = _plans(spark, d)
    return plans.groupBy("scenario_id").agg(F.max("status").alias("status"), F.max("objective").alias("objective"), F.count("course_id").alias("n_courses"))


def plan_check(spark, d):
    """Rules that solved plans break: none."""
    plans, tree = _plans(spark, d)
    good = plans.where("status = 'OK' and course_id is not null")
    return planning.plan_violations(good, "scenario_id", tree.free, _courses(spark, d), 0, 24)


def plan_violations(spark, d):
    """Rules that a made plan breaks: every course once, the terms dealt out by the order of ids, 5 to 24 credits a term."""
    place = F.row_number().over(Window.partitionBy("area1").orderBy("id"))
    dealt = _courses(spark, d).select("id", F.coalesce(F.get("area", F.lit(0)), F.lit("")).alias("area1"), F.col("credits.total").alias("credits"))
    plan = dealt.select(F.col("area1").alias("scenario"), F.col("id").alias("course_id"), (place % HORIZON + 1).alias("term"), "credits")
    return planning.plan_violations(plan, "scenario", materialize(_links(spark, d), "links"), _courses(spark, d), 5, 24)


def plan_render(spark, d):
    plans, _ = _plans(spark, d)
    return rendering.render_plan(plans, "scenario_id")


def prerequisite_answers(spark, d):
    """The rendered prerequisite answer of every course."""
    links = materialize(_links(spark, d), "links")
    f = graph.course_findings(_courses(spark, d), links)
    lines = f.groupBy(F.col("course_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "required"))), lambda x: x["required"]), " → ").alias("line"), F.sum(F.size(F.split("required", ", "))).alias("n_all"))
    adj = graph.adjacency(links, table(spark, d, "knowledge_graph")).select("id", F.col("incoming").alias("direct"))
    rows = _courses(spark, d).join(adj, "id").join(lines, "id", "left").select("id", X.display_name(F.col("id"), F.col("name")).alias("shown"), "direct", F.concat_ws(" → ", "line", "id").alias("line"), F.coalesce("n_all", F.lit(0)).alias("n_all"))
    return rows.select("id", rendering.prerequisite_answer(rows).alias("answer"))


def lookup_answers(spark, d):
    c = _courses(spark, d)
    return c.select("id", rendering.lookup_answer(X.display_name(F.col("id"), F.col("name")), F.col("credits.total"), F.col("semester"), F.col("compulsory")).alias("answer"))


def json_extract_robust(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("Reply: "), "props", F.lit(" end")).alias("t"), "event_type")
    j = generation.json_text(F.col("t"))
    return rows.select("event_id", F.get_json_object(j, "$.k").alias("k"), j.isNull().alias("failed"))


def router_replies(spark, d):
    q = F.col("query")
    reply = F.concat(F.lit("<think>hm</think>{\"route\": \""), F.when(q.contains("plan"), "SLOW").otherwise("FAST"), F.lit("\", \"intent\": \"x\", \"confidence\": "), F.when(F.length(q) > 60, "1.5").otherwise("0.5"), F.lit("}"))
    r = generation.router_reply(reply)
    return _asked(spark, d).select("answer_id", r["route"].alias("route"), r["confidence"].alias("confidence"), r["valid"].alias("valid"))


def generated_answers(spark, d):
    """The batch run with the offline generator: one row per question, answer or error."""
    made = generation.generate(_asked(spark, d).withColumn("prompt", F.concat(F.lit("SYSTEM: answer\nQUESTION: "), "query")), "prompt")
    return made.select("answer_id", "answer", "error")


QUERIES = {f.__name__: f for f in (alias_build, alias_update, alias_exact, alias_not_found, alias_contained, alias_fuzzy, alias_cascade, query_expansion, chunk_course_ids, kg_validate, kg_adjacency, kg_stats, kg_closure, kg_edge_evidence, kg_paths, kg_levels, kg_course_detail, kg_findings, kg_relevant, kg_execute, intent_label, route_decision, constraint_parse, constraint_current_term, plan_grid, plan_graph, plan_solve, plan_check, plan_violations, plan_render, prerequisite_answers, lookup_answers, json_extract_robust, router_replies, generated_answers)}

_ALIASES = f"""
    al AS (SELECT DISTINCT * FROM (
        SELECT canonical, -1 AS alias_pos, canonical AS alias FROM aliases WHERE canonical IS NOT NULL
        UNION ALL SELECT canonical, i - 1, aliases[i] FROM (SELECT canonical, aliases, unnest(generate_series(1, len(aliases))) AS i FROM aliases WHERE canonical IS NOT NULL)
    ) WHERE alias IS NOT NULL),
    tab AS (SELECT * FROM (SELECT *, {sql_key_ascii('alias')} AS key FROM al) WHERE key <> '')"""
_TYPE = "(type IS NULL OR lower(trim(type)) = 'prerequisite')"
_LINKS = f"""
    ids AS (SELECT DISTINCT upper(trim(id)) AS id FROM knowledge_graph WHERE trim(id) <> ''),
    links AS (SELECT DISTINCT upper(trim("from")) AS parent, upper(trim("to")) AS child FROM edges
        WHERE {_TYPE} AND upper(trim("from")) IN (SELECT id FROM ids) AND upper(trim("to")) IN (SELECT id FROM ids))"""
_REACH = """
    reach AS (SELECT parent AS a, child AS b FROM links UNION SELECT r.a, l.child FROM reach r JOIN links l ON l.parent = r.b),
    cyc AS (SELECT DISTINCT a AS n FROM reach WHERE a = b)"""
_COURSE = """
    cs AS (SELECT id, c.* FROM (
        SELECT id, arg_max({'name': name, 'credits': credits, 'semester': semester, 'compulsory': compulsory, 'area': area, 'language': language}, coalesce(version, '')) AS c
        FROM knowledge_graph WHERE id IS NOT NULL GROUP BY id))"""
_SHOWN = "id || CASE WHEN coalesce(nullif(name['en'], ''), nullif(name['vi'], '')) IS NULL THEN '' ELSE ' (' || coalesce(nullif(name['en'], ''), nullif(name['vi'], '')) || ')' END"
_SEM = "CASE WHEN semester = 'all' THEN 'every semester' WHEN len(CAST(semester AS INTEGER[])) = 1 THEN 'semester ' || CAST(semester AS INTEGER[])[1] ELSE 'semesters ' || array_to_string(CAST(semester AS INTEGER[]), ', ') END"
_SEM = _SEM.replace("CAST(semester AS INTEGER[])", "CAST(CASE WHEN semester <> 'all' THEN semester END AS INTEGER[])")


def _any(words, c="query"):
    return "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"


_CODES = sql_ordered_distinct(sql_codes("query"))
_INTENT = f"CASE WHEN {_any(routing.PLANNING)} THEN 'course_planning' WHEN {_any(routing.PREREQUISITE)} THEN 'prerequisite_reasoning' WHEN len({_CODES}) > 0 AND {_any(routing.LOOKUP)} THEN 'course_lookup' ELSE 'generic' END"


_CREDITS = r"(?i)(\d{1,9})\s*(?:tín|tin|credit)"
_REMAINING = r"(?i)(?:còn|con|remaining|next|trong)\s*(\d{1,9})\s*(?:kỳ|ki|hoc\s*ky|học\s*kỳ|semester|term)"
_CURRENTLY = r"(?i)(?:đang\s*học|current)\s*(?:kỳ|kì|hoc\s*ky|học\s*kỳ|semester)\s*(\d{1,9})"
_COMPLETED = r"(?i)(?:đã\s*xong|đã\s*học\s*xong|da\s*xong|da\s*hoc\s*xong|đã\s*hoàn\s*thành|da\s*hoan\s*thanh|hoàn\s*tất|hoan\s*tat|xong)\s*(?:hk|học\s*kỳ|hoc\s*ky|học\s*kì|hoc\s*ki|semester)\s*(\d{1,9})"


def _nums(p):
    return f"list_transform(regexp_extract_all(query, '{p}', 1), lambda x: CAST(x AS INTEGER))"


_ASKED = "(SELECT DISTINCT answer_id, query FROM answers WHERE query IS NOT NULL)"
_CURRENT = f"coalesce(TRY_CAST(nullif(regexp_extract(query, '{_CURRENTLY}', 1), '') AS INTEGER), list_max({_nums(_COMPLETED)}) + 1)"

# the first name of the least version, absent ones last, as the operator's docstring has it
_BUILT = r"""
    named AS (
        SELECT id, name['vi'] AS vi, name['en'] AS en, row_number() OVER (
            PARTITION BY id ORDER BY coalesce(version, ''), name['vi'] IS NULL, name['vi'], name['en'] IS NULL, name['en']) AS place
        FROM knowledge_graph WHERE id IS NOT NULL),
    built AS (
        SELECT id, list_distinct(list_filter([id, vi, en, CASE WHEN length(id) >= 6 AND regexp_full_match(id, '[A-Z]{2,4}\d{2,3}[A-Z]{0,3}')
            THEN rtrim(regexp_replace(id, '^([A-Z]{2,4})(\d{2,3})([A-Z]{0,3})$', '\1 \2 \3')) END], lambda x: x IS NOT NULL AND x <> '')) AS made
        FROM named WHERE place = 1)"""

SQL = {
    "alias_build": f"WITH {_BUILT} SELECT id AS canonical, CAST(len(made) AS INTEGER) AS n_aliases FROM built",
    "alias_update": f"""
        WITH {_BUILT}
        SELECT canonical, string_agg(a, '|' ORDER BY a) AS aliases FROM (
            SELECT canonical, unnest(aliases) AS a FROM aliases WHERE canonical IS NOT NULL UNION SELECT id, unnest(made) FROM built
        ) WHERE a IS NOT NULL GROUP BY canonical""",
    "alias_exact": f"""
        WITH {_ALIASES}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY (alias_pos >= 0), canonical, alias_pos) AS r FROM tab)
        SELECT key AS token, canonical, alias AS matched, CASE WHEN alias_pos < 0 THEN 'exact' ELSE 'exact-alias' END AS method, CASE WHEN alias_pos < 0 THEN 1.0 ELSE 0.98 END::DOUBLE AS confidence FROM r WHERE r = 1""",
    "alias_not_found": f"""
        WITH {_ALIASES},
        m AS (SELECT DISTINCT replace(unnest(regexp_extract_all(regexp_replace({sql_key_ascii('query')}, '([^a-z0-9])', '\\1\\1', 'g'), '(?:^|[^a-z0-9])([a-z]{{2,4}}(?:  )?\\d{{2,3}}[a-z]{{0,3}})(?:$|[^a-z0-9])', 1)), '  ', ' ') AS token FROM {_ASKED}),
        n AS (SELECT token, upper(replace(token, ' ', '')) AS matched FROM m)
        SELECT token, matched, 'not-found' AS method FROM n WHERE regexp_full_match(matched, '[A-Z]{{2,4}}\\d{{2,3}}[A-Z]{{0,3}}') AND matched NOT IN (SELECT upper(canonical) FROM tab WHERE alias_pos < 0)""",
    "chunk_course_ids": f"""
        WITH one AS (SELECT regexp_extract(id, '^{X.CODE_PREFIX}') AS token, min(id) AS canonical FROM knowledge_graph GROUP BY 1),
        m AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(upper(text), '({X.CODE_PREFIX})', 1)) AS token FROM ({sql_chunk_rows()}) WHERE text IS NOT NULL)
        SELECT chunk_id, string_agg(DISTINCT canonical, ',' ORDER BY canonical) AS course_ids FROM m JOIN one USING (token) WHERE token <> '' GROUP BY chunk_id""",
    "kg_validate": """
        WITH n AS (SELECT DISTINCT id, unnest(list_filter([
            CASE WHEN coalesce(trim(id), '') = '' THEN 'id' END, CASE WHEN coalesce(trim(language), '') = '' THEN 'language' END,
            CASE WHEN NOT coalesce(credits.total = credits.theory + credits.lab, false) THEN 'credits' END,
            CASE WHEN NOT coalesce(semester = 'all' OR (len(TRY_CAST(CASE WHEN semester <> 'all' THEN semester END AS INTEGER[])) > 0 AND list_min(TRY_CAST(CASE WHEN semester <> 'all' THEN semester END AS INTEGER[])) > 0), false) THEN 'semester' END,
            CASE WHEN NOT coalesce(compulsory IN ('Compulsory', 'Elective'), false) THEN 'compulsory' END,
            CASE WHEN coalesce(eligibility.min_credits < 0, false) THEN 'eligibility' END], lambda x: x IS NOT NULL)) AS rule FROM knowledge_graph),
        k AS (SELECT DISTINCT id FROM knowledge_graph WHERE id IS NOT NULL),
        e AS (SELECT coalesce("from", '?') || '>' || coalesce("to", '?') AS id, "from" AS f, "to" AS t, type FROM edges)
        SELECT 'node' AS entity, id, rule FROM n
        UNION SELECT 'edge', id, 'endpoint' FROM e WHERE f IS NULL OR t IS NULL OR f NOT IN (SELECT id FROM k) OR t NOT IN (SELECT id FROM k)
        UNION SELECT 'edge', id, 'type' FROM e WHERE coalesce(lower(trim(type, ' ')), 'prerequisite') <> 'prerequisite'""",
    "kg_adjacency": f"""
        WITH {_LINKS}
        SELECT id, coalesce((SELECT string_agg(parent, ',' ORDER BY parent) FROM links WHERE child = id), '') AS incoming, coalesce((SELECT string_agg(child, ',' ORDER BY child) FROM links WHERE parent = id), '') AS outgoing
        FROM (SELECT DISTINCT id FROM knowledge_graph)""",
    "kg_stats": f"WITH {_LINKS} SELECT (SELECT count(DISTINCT id) FROM knowledge_graph) AS n_nodes, count(*) AS n_edges FROM links",
    "kg_closure": f"""
        WITH RECURSIVE {_LINKS}, cl AS (SELECT DISTINCT id AS seed, id AS node, 0 AS depth FROM knowledge_graph UNION SELECT seed, parent, depth + 1 FROM cl JOIN links ON child = node WHERE depth < 2)
        SELECT seed, node, min(depth) AS depth FROM cl GROUP BY ALL""",
    "kg_edge_evidence": f"""
        WITH RECURSIVE {_LINKS}, cl AS (SELECT DISTINCT id AS seed, id AS node, 0 AS depth FROM knowledge_graph UNION SELECT seed, parent, depth + 1 FROM cl JOIN links ON child = node WHERE depth < 4),
        ev AS (SELECT DISTINCT seed, child || ' <- ' || parent AS evidence FROM cl JOIN links ON child = node)
        SELECT * FROM (SELECT seed, CAST(row_number() OVER (PARTITION BY seed ORDER BY evidence) AS INTEGER) AS place, evidence FROM ev) WHERE place <= 120""",
    "kg_paths": f"""
        WITH RECURSIVE {_LINKS}, ch AS (
            SELECT DISTINCT id AS course, id AS head, [id] AS chain FROM knowledge_graph
            UNION ALL SELECT course, parent, list_prepend(parent, chain) FROM ch JOIN links ON child = head WHERE NOT list_contains(chain, parent) AND parent <> child)
        SELECT course, array_to_string(chain, '>') AS chain FROM ch WHERE head NOT IN (SELECT child FROM links WHERE parent <> child)""",
    "kg_levels": f"""
        WITH RECURSIVE {_LINKS}, {_REACH},
        ends AS (SELECT parent AS n FROM links UNION SELECT child FROM links),
        bad AS (SELECT n FROM cyc UNION SELECT b FROM reach WHERE a IN (SELECT n FROM cyc)),
        dp AS (SELECT n AS node, 0 AS level FROM ends WHERE n NOT IN (SELECT child FROM links) UNION SELECT child, level + 1 FROM dp JOIN links ON parent = node WHERE child NOT IN (SELECT n FROM bad))
        SELECT n AS node, (SELECT max(level) FROM dp WHERE node = n) AS level FROM ends""",
    "kg_course_detail": f"WITH {_COURSE} SELECT id, {_SHOWN} AS shown, credits.total AS credits, {_SEM} AS offered, compulsory FROM cs",
    "intent_label": f"SELECT answer_id, intent, CASE intent WHEN 'course_planning' THEN 'plan' WHEN 'prerequisite_reasoning' THEN 'prerequisites' WHEN 'course_lookup' THEN 'lookup' ELSE 'general' END AS template FROM (SELECT answer_id, {_INTENT} AS intent FROM {_ASKED})",
    "route_decision": f"""
        WITH r AS (SELECT answer_id, min(query) AS query, max(aliases.confidence) AS score FROM answers WHERE query IS NOT NULL GROUP BY 1), i AS (SELECT *, {_INTENT} AS it, {_CODES} AS codes FROM r)
        SELECT answer_id, CASE WHEN it = 'course_planning' OR NOT coalesce(score >= 0.7, false) THEN 'SLOW' ELSE 'FAST' END AS first_route,
            array_to_string(list_filter([CASE WHEN score IS NULL THEN 'no_scores' END, CASE WHEN score < 0.7 THEN 'low_score' END, CASE WHEN score >= 0.7 THEN 'high_score' END, CASE WHEN it = 'course_planning' THEN 'planning' END], lambda x: x IS NOT NULL), ',') AS signals,
            round(greatest(0.0, least(1.0, coalesce(score, 0.0))), 6) AS confidence, CASE WHEN it = 'course_planning' THEN 'SLOW' ELSE 'FAST' END AS route,
            CASE WHEN it = 'generic' THEN 'course_lookup' ELSE it END AS intent, array_to_string(list_sort(codes), ',') AS entities FROM i""",
    "constraint_parse": f"""
        SELECT answer_id, list_min({_nums(_CREDITS)}) AS min_credits, list_max({_nums(_CREDITS)}) AS max_credits, list_max({_nums(_REMAINING)}) AS terms_remaining,
            {_CURRENT} AS current_term, array_to_string({_CODES}, ',') AS completed_courses,
            coalesce(nullif(list_min({_nums(_CREDITS)}), 0), 14) AS plan_min, coalesce(nullif(list_max({_nums(_CREDITS)}), 0), 24) AS plan_max FROM {_ASKED}""",
    "constraint_current_term": f"""
        WITH {_COURSE}, f AS (SELECT id, CASE WHEN semester = 'all' THEN 1 ELSE list_min(CAST(CASE WHEN semester <> 'all' THEN semester END AS INTEGER[])) END AS first FROM cs),
        q AS (SELECT answer_id, unnest({_CODES}) AS code FROM {_ASKED}),
        m AS (SELECT answer_id, max(first) AS last FROM q JOIN f ON f.id = code GROUP BY 1)
        SELECT answer_id, greatest(1, least(8, coalesce(last + 1, 1))) AS inferred_term FROM (SELECT DISTINCT answer_id FROM {_ASKED}) LEFT JOIN m USING (answer_id)""",
    "plan_grid": f"""
        WITH {_COURSE}, g AS (SELECT id, credits.total AS credits, unnest(list_distinct(CASE WHEN semester = 'all' THEN range(1, 9) ELSE CAST(CASE WHEN semester <> 'all' THEN semester END AS BIGINT[]) END)) AS term FROM cs)
        SELECT id, CAST(term AS INTEGER) AS term, credits FROM g WHERE term BETWEEN 1 AND 8""",
    "plan_graph": f"""
        WITH {_LINKS}, gone AS (SELECT DISTINCT unnest({_CODES}) AS id FROM {_ASKED} WHERE contains(lower(query), 'finished'))
        SELECT parent, child FROM links WHERE parent NOT IN (SELECT id FROM gone) AND child NOT IN (SELECT id FROM gone)""",
    "plan_violations": f"""
        WITH {_LINKS}, {_COURSE},
        dealt AS (SELECT id, coalesce(area[1], '') AS s, semester, credits.total AS credits FROM cs),
        plan AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY id) % 8 + 1 AS term FROM dealt),
        load AS (SELECT s, term, sum(credits) AS credits, max(term) OVER (PARTITION BY s) AS last FROM plan GROUP BY s, term)
        SELECT s AS scenario, 'offered' AS rule, id AS detail FROM plan
        WHERE NOT coalesce(semester = 'all' OR list_contains(TRY_CAST(CASE WHEN semester <> 'all' THEN semester END AS BIGINT[]), term), false)
        UNION ALL SELECT b.s, 'order', b.id FROM plan b JOIN links l ON l.child = b.id LEFT JOIN plan a ON a.id = l.parent AND a.s = b.s WHERE a.term IS NULL OR a.term >= b.term
        UNION ALL SELECT s, 'load', CAST(term AS VARCHAR) FROM load WHERE credits > 24 OR (term < last AND credits < 5)""",
    "lookup_answers": f"WITH {_COURSE} SELECT id, {_SHOWN} || ': ' || concat_ws('; ', credits.total || ' credits', 'offered in ' || {_SEM}, lower(compulsory)) || '.' AS answer FROM cs",
    "json_extract_robust": "SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NULL OR NOT json_valid(props) AS failed FROM events",
    "router_replies": f"SELECT answer_id, CASE WHEN contains(query, 'plan') THEN 'SLOW' ELSE 'FAST' END AS route, CASE WHEN length(query) > 60 THEN 1.5 ELSE 0.5 END::DOUBLE AS confidence, length(query) <= 60 AS valid FROM {_ASKED}",
    "generated_answers": f"SELECT answer_id, trim('QUESTION: ' || query, ' ') AS answer, CAST(NULL AS VARCHAR) AS error FROM {_ASKED}",
}
