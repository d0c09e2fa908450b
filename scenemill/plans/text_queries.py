"""Reply parsing, resume, legacy rules, scenario documents and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenemill.functions import scalar as fs
from scenemill.operators import events as ev
from scenemill.operators import replies as rp
from scenemill.operators import scenario as sc
from scenemill.operators import tracks as tr
from scenemill.plans.registry import query, table
from scenemill.plans.series_queries import KF, keyframes
from scenemill.plans.world_queries import AGENTS, agents
from scenemill.sources import readers as rd


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of every kind made from events: nested, fenced, with a trailing comma, torn, empty, and backend errors."""
    k = F.get_json_object("props", "$.k").cast("int")
    yes = F.when(k % 2 == 0, "yes").otherwise("no")
    raw = (
        F.when(k % 7 == 0, F.format_string('Sure: {"Click": "%s", "group": {"error": %s}} and {more', yes, (k > 50).cast("string")))
        .when(k % 7 == 1, F.format_string('```json\n{"click": %s, "error": "No", "note": "a } brace"}\n```', (k > 30).cast("string")))
        .when(k % 7 == 2, F.format_string('{"click": "%s", "error": true, }', yes)).when(k % 7 == 3, '{"click": tr').when(k % 7 == 4, "I cannot tell.")
        .when(k % 7 == 5, "").otherwise('{"click": maybe}')
    )
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"), (F.col("event_id") % 10 == 0).alias("backend_error"), k.alias("k"))


RAW = "rep AS (SELECT event_id, (props::JSON->>'k')::INT AS k, event_id % 10 = 0 AS backend_error FROM events)"


@query("extract_json", f"""WITH {RAW} SELECT event_id, CASE k % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'ok_after_trailing_comma_fix' WHEN 3 THEN 'unbalanced_braces' WHEN 4 THEN 'no_json_object' WHEN 5 THEN 'empty_output' ELSE 'json_decode_error' END AS reason FROM rep""")
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replies(spark, sf_dir).withColumn("j", rp.extract_json("raw"))
    return found.select("event_id", F.split("j.reason", ":")[0].alias("reason"))


@query("json_coerce", f"""WITH {RAW}, t AS (SELECT unnest(['click', 'error', 'other']) AS tag)
SELECT event_id, tag, CASE WHEN tag = 'click' AND k % 7 IN (0, 2) THEN k % 2 = 0 WHEN tag = 'click' AND k % 7 = 1 THEN k > 30 WHEN tag = 'error' AND k % 7 = 0 THEN k > 50
WHEN tag = 'error' AND k % 7 = 1 THEN false WHEN tag = 'error' AND k % 7 = 2 THEN true END AS yhat FROM rep, t""")
def json_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replies(spark, sf_dir).select("event_id", F.coalesce(rp.extract_json("raw")["json"], F.lit("{}")).alias("json"))
    return rp.coerce_tags(found, "event_id", "json", ["click", "error", "other"])


@query("parse_failure", f"WITH {RAW} SELECT count(*) AS n, count(*) FILTER (k % 7 > 2) AS failed, round(avg((k % 7 > 2)::INT), 6) AS failure_rate FROM rep WHERE NOT backend_error")
def parse_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rp.failure_rate(replies(spark, sf_dir).withColumn("reason", rp.extract_json("raw")["reason"]), "reason", "backend_error")
    return found.withColumn("failure_rate", F.round("failure_rate", 6))


@query("resume_todo", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.todo(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@query("scope_prompts", """WITH d AS (SELECT * FROM (VALUES (1, 'long', 'text', 'more than 2000'), (2, 'toxic', 'label', 'marked toxic'), (3, 'english', 'text', 'in English')) v(ord, tag, scope, derivation))
SELECT scope, 'Answer true or false for each:' || chr(10) || string_agg('- ' || tag || ': ' || derivation, chr(10) ORDER BY ord) AS prompt, count(*) AS n_tags FROM d GROUP BY scope""")
def scope_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "long", "text", "more than 2000"), (2, "toxic", "label", "marked toxic"), (3, "english", "text", "in English")]
    return rp.prompts(spark.createDataFrame(rows, "ord int, tag string, scope string, derivation string"))


@query("text_reference", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licen[sc]ed?\\s+under|released\\s+under') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def text_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"(?i)licen[sc]ed?\s+under|released\s+under"))
    return hits.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_anti").select("doc_id")


@query("log_lighting", """WITH h AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE hour(ts)::INT END AS hour FROM events)
SELECT event_id, hour, CASE WHEN hour IS NULL THEN 'unknown' WHEN hour >= 18 OR hour < 6 THEN 'night' ELSE 'day' END AS lighting FROM h""")
def log_lighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_id") % 13 == 0, "unnamed").otherwise(F.concat(F.lit("n015-"), F.date_format("ts", "yyyy-MM-dd-HH-mm-ss"), F.lit("+0800")))
    hour = fs.hour_of_log(name)
    return table(spark, sf_dir, "events").select("event_id", hour.alias("hour"), fs.lighting(hour).alias("lighting"))


@query("answer_key", r"""WITH a AS (SELECT p_partkey, 'The ' || upper(p_type) || 's. ' AS raw FROM part), n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '[.!?,;:]+$', ''), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS k FROM a)
SELECT p_partkey, CASE WHEN k NOT IN ('promo', 'small') AND regexp_replace(k, 's$', '') IN ('promo', 'small') THEN regexp_replace(k, 's$', '') ELSE k END AS answer FROM n""")
def answer_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("The "), F.upper("p_type"), F.lit("s. "))
    return table(spark, sf_dir, "part").select("p_partkey", fs.answer_key(raw, F.array(F.lit("promo"), F.lit("small"))).alias("answer"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = agents(spark, sf_dir)
    frames = own.select("scene", "frame", F.col("category").alias("label")).groupBy("scene", "frame").agg(F.min("label").alias("label"))
    panels = ev.collapse(frames.withColumns({"first": F.col("frame"), "last": F.col("frame")}), "scene", "first", "last", "label")
    return sc.descriptions(panels, tr.actors(own, "scene", 6.0), "scene")


@query("scenario_documents", f"""WITH {AGENTS}, f AS (SELECT scene, frame, min(category) AS label FROM ag GROUP BY scene, frame),
n AS (SELECT *, CASE WHEN label = lag(label) OVER w THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY scene ORDER BY frame)),
p AS (SELECT scene, frame, label, sum(new) OVER (PARTITION BY scene ORDER BY frame) AS panel FROM n), q AS (SELECT scene, panel, label, min(frame) AS first, max(frame) AS last FROM p GROUP BY ALL),
t AS (SELECT scene, count(*)::INT AS n_panels, max(last) AS length, arg_min(label, first) AS opening FROM q GROUP BY scene),
a AS (SELECT scene, category, count(DISTINCT instance) AS n FROM ag GROUP BY scene, category), b AS (SELECT scene, category AS main_actor FROM a QUALIFY row_number() OVER (PARTITION BY scene ORDER BY n DESC, category) = 1)
SELECT scene, n_panels, length, opening, main_actor FROM t JOIN b USING (scene)""")
def scenario_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir)
    return rows.select("scene", "n_panels", "length", F.get("timeline", F.lit(0))["label"].alias("opening"), F.get("actors", F.lit(0))["category"].alias("main_actor"))


SPEEDS, STEERINGS = {"click": "accelerating", "view": "decelerating", "signup": "stationary"}, {"error": "turn_left", "purchase": "turn_right"}
_CASE = lambda names, default: "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE '{default}' END"
PANELS = f"""rch AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM kf WINDOW w AS (PARTITION BY user_id ORDER BY k)),
rnum AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY k) AS run FROM rch), pn AS (SELECT user_id, run, min(t) AS a, max(t) AS b, {_CASE(SPEEDS, "cruising")} AS speed, {_CASE(STEERINGS, "going_straight")} AS steering FROM rnum GROUP BY user_id, run, event_type)"""


def _panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyframes(spark, sf_dir)
    runs = ev.label_runs(rows, "user_id", "k", ["event_type"])
    ends = rows.select("user_id", "k", "t")
    runs = runs.join(ends.select("user_id", F.col("k").alias("first"), F.col("t").alias("first_s")), ["user_id", "first"]).join(ends.select("user_id", F.col("k").alias("last"), F.col("t").alias("last_s")), ["user_id", "last"])

    def named(names: dict[str, str], default: str):
        out = F.lit(default)
        for kind, label in names.items():
            out = F.when(F.col("event_type") == kind, label).otherwise(out)
        return out

    return runs.select("user_id", F.col("run").cast("int").alias("panel"), "first_s", "last_s", named(SPEEDS, "cruising").alias("speed"), named(STEERINGS, "going_straight").alias("steering"), (F.col("n") > 2).alias("lane_change"))


def _scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenemill.plans.drive_queries import context, frames, states

    on = context(spark, sf_dir)
    rows = frames(spark, sf_dir).join(on, "event_id").withColumns(
        {"hour": F.hour(F.timestamp_micros("us")), "ped_crossing": F.col("on_ped_crossing") | F.col("ped_crossing_ahead"), "stop_line": F.col("on_stop_line") | F.col("stop_line_ahead")}
    )
    return sc.documents(rows, _panels(spark, sf_dir), states(spark, sf_dir), "user_id", "location", 1e-4)


@query("scenario_xml")
def scenario_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.to_xml(_scenario(spark, sf_dir), "user_id")


@query("scenario_field_population")
def scenario_field_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.field_population(_scenario(spark, sf_dir))


@query("simulator_field_mapping")
def simulator_field_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.field_mapping(_scenario(spark, sf_dir))


def _sql_track(name: str, turn: float) -> str:
    """``<name>(user_id, i, t, speed, yaw, x, y)``: the track of the panels on a grid of 6."""
    past = "OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""v_{name} AS (SELECT *, CASE speed WHEN 'stationary' THEN 0.0 WHEN 'accelerating' THEN 9.0 WHEN 'decelerating' THEN 1.0 END::DOUBLE AS own, first(CASE speed WHEN 'stationary' THEN 0.0 WHEN 'accelerating' THEN 1.0 WHEN 'decelerating' THEN 9.0 ELSE 5.0 END::DOUBLE) OVER (PARTITION BY user_id ORDER BY run) AS v0,
CASE WHEN steering = lag(steering) OVER (PARTITION BY user_id ORDER BY run) THEN 0 ELSE 1 END AS nt FROM pn),
c_{name} AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v0) AS cur, sum(nt) OVER (PARTITION BY user_id ORDER BY run) AS tg FROM v_{name}),
d_{name} AS (SELECT *, coalesce(own, cur) AS tgt, min(a) OVER (PARTITION BY user_id, tg) AS ta, max(b) OVER (PARTITION BY user_id, tg) AS tb FROM c_{name}),
g_{name} AS (SELECT user_id, unnest(range(0, floor(max(t) / 6)::BIGINT + 1)) AS i FROM kf GROUP BY user_id),
s_{name} AS (SELECT g.user_id, g.i, g.i * 6.0::DOUBLE AS t, d.*  EXCLUDE (user_id) FROM g_{name} g JOIN d_{name} d ON d.user_id = g.user_id AND d.a <= g.i * 6.0::DOUBLE QUALIFY row_number() OVER (PARTITION BY g.user_id, g.i ORDER BY d.run DESC) = 1),
h_{name} AS (SELECT user_id, i, t, CASE WHEN t > b THEN tgt WHEN b > a THEN cur + (tgt - cur) * (t - a) / (b - a) ELSE cur END AS speed,
CASE WHEN t < tb AND tb > ta THEN radians(CASE steering WHEN 'turn_left' THEN {turn} WHEN 'turn_right' THEN -{turn} ELSE 0 END) / (tb - ta) ELSE 0 END AS rate FROM s_{name}),
y_{name} AS (SELECT *, coalesce(sum(rate * 6) {past}, 0) AS yaw FROM h_{name}), {name} AS (SELECT *, coalesce(sum(speed * cos(yaw) * 6) {past}, 0) AS x, coalesce(sum(speed * sin(yaw) * 6) {past}, 0) AS y FROM y_{name})"""


@query("described_track", f"WITH {KF}, {PANELS}, {_sql_track('tr', 90.0)} SELECT user_id, i, round(t, 6) AS t, round(speed, 6) AS speed, round(yaw, 6) AS yaw, round(x, 4) AS x, round(y, 4) AS y FROM tr")
def described_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _track(spark, sf_dir, 90.0)
    return found.select("user_id", F.col("i").cast("long").alias("i"), *[F.round(c, 6).alias(c) for c in ("t", "speed", "yaw")], F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def _track(spark: SparkSession, sf_dir: str, turn: float) -> DataFrame:
    steps = keyframes(spark, sf_dir).groupBy("user_id").agg((F.floor(F.max("t") / 6) + 1).cast("int").alias("n_steps"))
    ranges = steps.withColumns({"vmin": F.lit(1.0), "vmax": F.lit(9.0), "right_hand": F.lit(True)})
    return sc.described_track(_panels(spark, sf_dir), ranges, "user_id", 6.0, turn)


@query("replay_metrics", f"""WITH {KF}, {PANELS}, {_sql_track('ta', 90.0)}, {_sql_track('tb', 80.0)}, j AS (SELECT a.user_id, a.i, a.x, a.y, a.yaw, b.x AS bx, b.y AS by_, b.yaw AS byaw FROM ta a JOIN tb b ON b.user_id = a.user_id AND b.i = a.i),
m AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS sa, coalesce(sqrt((bx - lag(bx) OVER w) ** 2 + (by_ - lag(by_) OVER w) ** 2), 0) AS sb FROM j WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, round(sum(sa), 4) AS path_a, round(sum(sb), 4) AS path_b, round(avg(sqrt((x - bx) ** 2 + (y - by_) ** 2)), 4) AS position_error,
round(avg(abs((yaw - byaw + pi()) - 2 * pi() * floor((yaw - byaw + pi()) / (2 * pi())) - pi())), 6) AS heading_error, count(*) AS n FROM m GROUP BY user_id""")
def replay_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sc.replay_metrics(_track(spark, sf_dir, 90.0), _track(spark, sf_dir, 80.0), "user_id", "i")
    return found.select("user_id", *[F.round(c, 4).alias(c) for c in ("path_a", "path_b", "position_error")], F.round("heading_error", 6).alias("heading_error"), "n")


# ---------------------------------------------------------------- legacy references, answers, text functions
@query("legacy_tags", f"""WITH {AGENTS}, g AS (SELECT *, fwd AS dx, lat * 4 AS dy, sqrt(fwd * fwd + lat * lat * 16) AS d FROM ag)
SELECT scene, frame, bool_or(category LIKE '%vehicle%') AS v1_has_parked_vehicle, bool_or(category LIKE '%construction%' OR category LIKE '%barrier%' OR category LIKE '%cone%') AS v1_has_construction, bool_or(category LIKE '%human%') AS v1_has_pedestrian, false AS v1_following_vehicle,
count(*) FILTER (category LIKE '%vehicle%' AND d <= 40 AND d < 20) >= 1 AS v2_has_parked_vehicle, count(*) FILTER (category LIKE '%cone%' AND d <= 40 AND d < 25) >= 2 AS v2_has_construction, count(*) FILTER (category LIKE '%human%' AND d <= 40 AND d < 15) >= 1 AS v2_has_pedestrian,
coalesce(bool_or(category LIKE '%vehicle%' AND d < 20 AND abs(dy) > abs(dx) AND d < 15), false) AS v2_following_vehicle,
bool_or(category LIKE '%vehicle%') AS v3_has_parked_vehicle, bool_or(category LIKE '%cone%') AS v3_has_construction, bool_or(category LIKE '%human%') AS v3_has_pedestrian, bool_or(category LIKE 'vehicle.car%') AS v3_following_vehicle FROM g GROUP BY scene, frame""")
def legacy_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = agents(spark, sf_dir).withColumns({"dx": F.col("fwd"), "dy": F.col("lat") * 4})
    return tr.legacy_references(rows, ["scene", "frame"], "dx", "dy", people="human", cones=("cone",), vehicles=("vehicle.car",))


QUESTIONS = """q AS (SELECT p_partkey AS qid, lower(p_type) AS answer, p_size % 4 AS kind FROM part), r AS (SELECT event_id AS qid, (props::JSON->>'k')::INT AS k FROM events),
a AS (SELECT qid, kind, answer, CASE WHEN k % 3 = 0 THEN answer WHEN k % 3 = 1 THEN 'bikes' END AS said FROM q JOIN r USING (qid) WHERE k % 11 <> 0)"""


@query("answered_questions", f"WITH {QUESTIONS} SELECT kind, count(*) AS n, round(avg(coalesce(said = answer, false)::INT), 6) AS accuracy, count(*) FILTER (CASE said WHEN 'bikes' THEN 'bicycle' ELSE said END = 'bicycle') AS n_bicycle FROM a GROUP BY kind")
def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.lower("p_type").alias("answer"), (F.col("p_size") % 4).alias("kind"))
    k = F.get_json_object("props", "$.k").cast("int")
    reply = F.when(k % 3 == 0, "same").when(k % 3 == 1, "bikes")
    logged = table(spark, sf_dir, "events").select(F.col("event_id").alias("qid"), reply.alias("said"), (k % 11 == 0).alias("backend_error"))
    rows = rp.answered(asked, logged, "qid").withColumn("said", F.when(F.col("said") == "same", F.col("answer")).otherwise(F.col("said")))
    return rows.groupBy("kind").agg(
        F.count("*").alias("n"), F.round(F.avg(F.coalesce(F.col("said") == F.col("answer"), F.lit(False)).cast("int")), 6).alias("accuracy"), F.count_if(fs.synonym(F.col("said")) == "bicycle").alias("n_bicycle")
    )


@query("text_functions", r"""WITH t AS (SELECT event_id, event_id % 5 AS m, event_type FROM events)
SELECT event_id, CASE m WHEN 0 THEN 'front left' WHEN 1 THEN 'back' END AS direction, CASE m WHEN 0 THEN 'left of' WHEN 2 THEN 'in front of' WHEN 3 THEN 'front' END AS relation, event_type AS stem,
CASE m WHEN 0 THEN 'moves' WHEN 1 THEN 'slow' WHEN 2 THEN 'a tree' WHEN 3 THEN 'one bus waits' ELSE 'nothing' END AS phrase FROM t""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 5
    choose = lambda *texts: F.element_at(F.array(*[F.lit(t) for t in texts]), (m + 1).cast("int"))
    question = choose("Is the car to the front left of me? It is left of it", "what is BACK of me", "What stands in front of it?", "the front wheel", "nobody")
    phrase = choose("the car moves", "the car is slow", "there is a tree", "at least one one bus waits", "nothing")
    path = F.concat(F.lit("images/day.1/"), F.col("event_type"), F.lit(".tar"))
    return table(spark, sf_dir, "events").select(
        "event_id", fs.ego_direction(question).alias("direction"), fs.relation(F.regexp_replace(question, "(?i)front left of me|back of me", ""), ["front", "in front of", "left of"]).alias("relation"),
        fs.stem(path).alias("stem"), fs.without_subject(phrase).alias("phrase"),
    )


@query("panel_captions", """WITH t AS (SELECT event_id, event_id % 4 AS m FROM events)
SELECT event_id, 'The car keeps straight on, ' || CASE WHEN m = 0 THEN 'stands still' ELSE 'speeds up' END || '.' || CASE WHEN m = 1 THEN ' A junction lies close ahead.' ELSE '' END ||
CASE m WHEN 2 THEN ' Also: a; b; c (+1 more).' WHEN 3 THEN ' Also: a.' ELSE '' END || CASE WHEN m = 3 THEN ' Briefly: x; y (+1 more).' ELSE '' END AS caption FROM t""")
def panel_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 4
    some = lambda *names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    longitudinal = F.when(m == 0, "the car stands still").otherwise("the car speeds up")
    setting, actors, partial = F.when(m == 1, some("a junction lies close ahead")).otherwise(some()), F.when(m == 2, some("a", "b", "c", "d")).when(m == 3, some("a")).otherwise(some()), F.when(m == 3, some("x", "y", "z")).otherwise(some())
    return table(spark, sf_dir, "events").select("event_id", fs.caption(F.lit("the car keeps straight on"), longitudinal, setting, actors, partial).alias("caption"))
