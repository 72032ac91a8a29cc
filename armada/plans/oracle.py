"""DuckDB SQL equal to every registered query (same column names).

Fixed values come from ``oracle_values``, not from the modules that are
checked. DuckDB notes: decimal
literals are cast to DOUBLE; lists index from 1; ``\\b`` is ASCII-only in
RE2, so the word boundary is spelled out as "not a letter, decimal digit or
underscore", which is what Java's ``\\b`` uses."""

from __future__ import annotations

from armada.plans import oracle_values as C

Q = T = C


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


WS = C.WS_CLASS
WORD = r"[^\p{L}\p{Nd}_]"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def parse(e: str) -> str:
    return f"nullif(regexp_extract({e}, '(?:^|{WORD})([A-D])(?:$|{WORD})', 1), '')"


def md5_byte(model: str, key: str) -> str:
    return f"CAST(('0x' || substr(md5({model} || ':' || CAST({key} AS VARCHAR)), 1, 2)) AS INTEGER)"


def values(rows, names) -> str:
    body = ", ".join("(" + ", ".join(rows_i) + ")" for rows_i in rows)
    return f"(SELECT * FROM (VALUES {body}) t({', '.join(names)}))"


ARMS = values([[str(i), lit(a), dbl(p)] for i, (a, p) in enumerate(zip(Q.ROUTE_CFG.arms, Q.ROUTE_CFG.prices))],
              ["arm_idx", "arm", "price"])
REGISTRY = values([[lit(m), lit(i)] for m, i in C.MODEL_REGISTRY], ["model", "model_id"])
TASKS = values([[str(i), lit(t)] for i, t in enumerate(C.TASKS)], ["task_idx", "task"])


def models_list(ms) -> str:
    return values([[lit(m)] for m in ms], ["model"])


QUESTIONS = """
questions AS (
  SELECT d.doc_id AS row_id, d.source AS task, d.text AS prompt, CAST(l.quality + 2 * l.toxic AS INTEGER) AS answer
  FROM documents d JOIN labels l USING (doc_id))"""

GRADING = f"""
resp0 AS (
  SELECT q.*, m.model, {md5_byte('m.model', 'q.row_id')} AS k
  FROM questions q CROSS JOIN {models_list(T.EVAL_MODELS)} m),
responses AS (
  SELECT model, task, row_id, prompt, answer,
    CASE WHEN k % 16 = 0 THEN NULL
         WHEN k % 16 = 1 THEN prompt || ' I cannot tell.'
         ELSE prompt || ' The answer is ' || chr(65 + k % 4) || '.' END AS generated_text,
    CAST(k % 50 + 1 AS DOUBLE) / 100.0 AS latency_sec
  FROM resp0),
graded0 AS (
  SELECT model, task, row_id, latency_sec, generated_text,
    CASE WHEN answer BETWEEN 0 AND 25 THEN chr(65 + answer) END AS ground_truth,
    {parse('substring(generated_text, length(prompt) + 1)')} AS parsed
  FROM responses),
graded AS (
  SELECT model, task, row_id, latency_sec, ground_truth,
    CASE WHEN generated_text IS NULL THEN 'ERROR' ELSE coalesce(parsed, 'NONE') END AS prediction,
    CAST(coalesce(parsed = ground_truth, false) AS INTEGER) AS correct,
    ground_truth IS NOT NULL AS answer_ok
  FROM graded0)"""

GRADED = f"{QUESTIONS},{GRADING}"


def ordinal_split(src: str, key: str, strata: str, seed: int, frac: float) -> str:
    """Stratified split CTEs over ``src``; defines ``split_rows``."""
    return f"""
s_counts AS (SELECT {strata}, count(*) AS ns FROM {src} GROUP BY {strata}),
s_tot AS (SELECT sum(ns) AS nn, CAST(floor({dbl(frac)} * sum(ns)) AS BIGINT) AS ntr FROM s_counts),
s_q0 AS (SELECT c.{strata}, (t.ntr * c.ns) // t.nn AS base, (t.ntr * c.ns) % t.nn AS rem, t.ntr FROM s_counts c, s_tot t),
s_q1 AS (SELECT {strata}, base, ntr - sum(base) OVER () AS extra,
                row_number() OVER (ORDER BY rem DESC, {strata}) AS rk FROM s_q0),
s_quota AS (SELECT {strata}, base + CASE WHEN rk <= extra THEN 1 ELSE 0 END AS quota FROM s_q1),
s_ranked AS (SELECT *, row_number() OVER (PARTITION BY {strata}
                ORDER BY md5('{seed}:' || CAST({key} AS VARCHAR)), {key}) AS s_rn FROM {src}),
split_rows AS (SELECT r.*, CASE WHEN r.s_rn <= q.quota THEN 'train' ELSE 'validation' END AS split
               FROM s_ranked r JOIN s_quota q USING ({strata}))"""


def _correct(k: int) -> str:
    return f"CAST(((label + {3 * k}) % 5) <= {k} AS INTEGER)"


CFG = Q.ROUTE_CFG
NORM = CFG.normalised_prices


def ctx_cte(two_d: bool) -> str:
    xs = ("list_sum(list_transform(embedding, lambda v, i: CASE WHEN (i - 1) % 2 = {b} THEN CAST(v AS DOUBLE) ELSE 0.0 END))")
    rw = ", ".join(f"CAST({_correct(k)} AS DOUBLE) - {dbl(CFG.p * NORM[k])} AS rw{k}" for k in range(CFG.k))
    cor = ", ".join(f"{_correct(k)} AS c{k}" for k in range(CFG.k))
    extra = f", {xs.format(b=0)} AS x0, {xs.format(b=1)} AS x1" if two_d else ""
    return f"ctx AS (SELECT vec_id AS row_id, label, embedding, {cor}, {rw}{extra} FROM embeddings)"


def route2d_ctes() -> str:
    lam = dbl(CFG.lam)
    bsum = " UNION ALL ".join(
        f"SELECT {k} AS arm_idx, sum(rw{k} * x0) AS b0, sum(rw{k} * x1) AS b1 FROM split_rows WHERE split = 'train'"
        for k in range(CFG.k))
    return f"""{ctx_cte(True)},
{ordinal_split('ctx', 'row_id', 'label', T.SPLIT_SEED, T.TRAIN_SIZE)},
g AS (SELECT {lam} + sum(x0 * x0) AS a00, sum(x0 * x1) AS a01, {lam} + sum(x1 * x1) AS a11
      FROM split_rows WHERE split = 'train'),
inv AS (SELECT a11 / (a00 * a11 - a01 * a01) AS i00, -a01 / (a00 * a11 - a01 * a01) AS i01,
               a00 / (a00 * a11 - a01 * a01) AS i11 FROM g),
bs AS ({bsum}),
theta AS (SELECT arm_idx, i00 * b0 + i01 * b1 AS t0, i01 * b0 + i11 * b1 AS t1 FROM bs, inv),
val AS (SELECT * FROM split_rows WHERE split = 'validation'),
scores AS (
  SELECT v.row_id, th.arm_idx,
         th.t0 * v.x0 + th.t1 * v.x1 + {dbl(CFG.alpha)} * sqrt(i00 * v.x0 * v.x0 + 2 * i01 * v.x0 * v.x1 + i11 * v.x1 * v.x1) AS ucb
  FROM val v, theta th, inv),
chosen AS (
  SELECT row_id, arm_idx, ucb FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY ucb DESC, arm_idx) AS rk FROM scores) WHERE rk = 1),
labels_long AS (
  {" UNION ALL ".join(f"SELECT row_id, {k} AS arm_idx, c{k} AS correct FROM val" for k in range(CFG.k))}),
outcomes AS (
  SELECT c.row_id, c.arm_idx, a.arm, c.ucb, l.correct, a.price
  FROM chosen c LEFT JOIN labels_long l USING (row_id, arm_idx) LEFT JOIN {ARMS} a USING (arm_idx))"""


def _mc_prompt_sql() -> str:
    lines = (f"array_to_string(list_transform(string_split(text, '. '), "
             f"lambda c, i: chr(CAST(64 + i AS INTEGER)) || '. ' || {strip('c')} || chr(10)), '')")
    return f"{lit(C.MC_PROMPT_HEAD)} || text || {lit(C.MC_PROMPT_OPTIONS)} || {lines} || {lit(C.MC_PROMPT_TAIL)}"


def _instruct_sql() -> str:
    lines = ("array_to_string(list_transform(ch, lambda c, i: chr(CAST(64 + i AS INTEGER)) || '). ' || c || chr(10)), '')")
    return (f"CASE WHEN len(ch) <= 4 THEN {lit(C.INSTRUCT_HEAD)} || replace(task, '_', ' ') || {lit(C.INSTRUCT_MID)}"
            f" || text || {lit(C.INSTRUCT_CHOICES)} || {lines} END")


def _learn_events() -> str:
    return ("SELECT event_id, ts, user_id, value / 100.0 AS x, "
            "CAST(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS r0, "
            "CAST(CASE WHEN (event_id + 1) % 3 = 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS r1 FROM events")


LC = Q.LEARN_CFG


def _u(a: str, b: str, x: str = "x") -> str:
    # same operation order as the Python learner: theta = b / a; mean = theta * x; var = x * x / a
    return f"(({b}) / ({a})) * {x} + {dbl(LC.alpha)} * sqrt({x} * {x} / ({a}))"


SQL = {}

SQL["q01_prompt_build"] = f"SELECT item_id, {_mc_prompt_sql()} AS prompt FROM benchmark"

SQL["q02_instruct_prompt"] = f"""
WITH it AS (
  SELECT b.item_id, b.text, t.task, string_split(b.text, '. ') AS ch
  FROM benchmark b JOIN {TASKS} t ON t.task_idx = b.item_id % {len(C.TASKS)})
SELECT item_id, task, CAST(len(ch) AS INTEGER) AS n_choices, {_instruct_sql()} AS prompt,
       CASE WHEN len(ch) > 4 THEN 'more than four choices' END AS error
FROM it"""

SQL["q03_parse_answer"] = f"""
WITH u AS (SELECT conv_id, turn, text AS prompt FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS reply FROM conversations WHERE role = 'assistant'),
b AS (SELECT u.conv_id, u.turn, u.prompt, u.prompt || a.reply AS gen FROM u LEFT JOIN a USING (conv_id, turn))
SELECT conv_id, turn,
  CASE WHEN gen IS NULL THEN 'ERROR' ELSE coalesce({parse('substring(gen, length(prompt) + 1)')}, 'NONE') END AS prediction
FROM b"""

SQL["q04_grade_predictions"] = f"""WITH {GRADED}
SELECT model, task, row_id, ground_truth, prediction, correct FROM graded"""

SQL["q05_model_task_accuracy"] = f"""WITH {GRADED}
SELECT model, task, round(avg(correct), 9) AS accuracy, round(sum(latency_sec) / count(*), 9) AS avg_time_sec,
       count(*) AS n
FROM graded GROUP BY model, task"""

SQL["q06_split_accuracy"] = f"""WITH {GRADED}
SELECT model, round(avg(correct), 9) AS accuracy, round(sum(latency_sec) / count(*), 9) AS avg_time_sec,
       count(*) AS n
FROM graded GROUP BY model"""

SQL["q07_run_report"] = f"""WITH {GRADED},
summary AS (
  SELECT model, task, avg(correct) AS accuracy, sum(latency_sec) / count(*) AS avg_time_sec, count(*) AS n,
         sum(CASE WHEN answer_ok THEN 0 ELSE 1 END) AS n_bad
  FROM graded GROUP BY model, task),
expected AS (
  SELECT m.model, r.model_id, t.task
  FROM (SELECT DISTINCT source AS task FROM documents) t CROSS JOIN {models_list(T.RUN_MODELS)} m
  JOIN {REGISTRY} r USING (model)),
rep AS (
  SELECT e.model, string_split(e.model_id, '/')[-1] AS model_name, e.task, s.accuracy, s.avg_time_sec,
         coalesce(s.n, 0) AS n,
         CASE WHEN coalesce(s.n, 0) = 0 THEN {lit(C.EMPTY_EVAL_ERROR)}
              WHEN coalesce(s.n_bad, 0) > 0 THEN 'answer outside 0..25' END AS error
  FROM expected e LEFT JOIN summary s USING (model, task))
SELECT model, model_name, task, model_name || '_' || task || '_test' AS result_key,
       CASE WHEN error IS NULL THEN round(accuracy, 9) END AS accuracy,
       CASE WHEN error IS NULL THEN round(avg_time_sec, 9) END AS avg_time_sec, n, error
FROM rep"""

SQL["q08_fraction_sample"] = f"""
SELECT doc_id, source FROM (
  SELECT doc_id, source,
    row_number() OVER (PARTITION BY source ORDER BY md5('{Q.SAMPLE_SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn,
    count(*) OVER (PARTITION BY source) AS n
  FROM documents)
WHERE rn <= round_even({dbl(Q.SAMPLE_FRACTION)} * n, 0)"""

SQL["q09_four_way_cut"] = """
SELECT doc_id, lang, CAST(CASE WHEN n // 4 = 0 THEN 4 ELSE least((rn - 1) // (n // 4) + 1, 4) END AS INTEGER) AS part
FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn,
             count(*) OVER (PARTITION BY lang) AS n FROM documents)"""

SQL["q10_stratified_split"] = f"""WITH docs AS (SELECT doc_id, source FROM documents),
{ordinal_split('docs', 'doc_id', 'source', 1010, 0.75)}
SELECT doc_id, source, split FROM split_rows"""

SQL["q11_pending_work"] = """
SELECT d.doc_id, d.source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""

SQL["q12_last_token_pool"] = """
WITH tok AS (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, pos AS pooled_pos, CAST(value AS DOUBLE) AS pooled_0, CAST(pos AS DOUBLE) AS pooled_1
FROM tok WHERE pos = CASE WHEN user_id % 2 = 0 THEN n - 1 ELSE n - n // 3 - 1 END"""

SQL["q13_hash_embedding"] = f"""
WITH toks AS (
  SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\x{{0B}}\\x{{0C}}]+')) AS t FROM documents),
counts AS (
  SELECT doc_id, CAST(CAST(('0x' || substr(md5(t), 1, 4)) AS INTEGER) % {Q.HASH_DIM} AS INTEGER) AS bucket,
         count(*) AS cnt
  FROM toks WHERE length(t) > 0 GROUP BY ALL)
SELECT doc_id, bucket, cnt, round(cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY doc_id)), 9) AS weight FROM counts"""

SQL["q14_gram"] = f"""WITH {ctx_cte(False)},
{ordinal_split('ctx', 'row_id', 'label', T.SPLIT_SEED, T.TRAIN_SIZE)},
el AS (SELECT row_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i
       FROM split_rows WHERE split = 'train'),
pairs AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS s FROM el a JOIN el b ON a.row_id = b.row_id AND b.i >= a.i
          GROUP BY a.i, b.i)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
       round(s + CASE WHEN i = j THEN {dbl(CFG.lam)} ELSE 0.0 END, 9) AS a FROM pairs"""

SQL["q15_rewards"] = f"""
WITH a AS (SELECT *, price / max(price) OVER () AS norm_price FROM {ARMS})
SELECT e.vec_id AS row_id, a.arm_idx, a.arm,
       CAST(((e.label + 3 * a.arm_idx) % 5) <= a.arm_idx AS INTEGER) AS correct,
       round(CAST(CAST(((e.label + 3 * a.arm_idx) % 5) <= a.arm_idx AS INTEGER) AS DOUBLE)
             - {dbl(CFG.p)} * a.norm_price, 9) AS reward
FROM embeddings e CROSS JOIN a"""

SQL["q16_reward_sums"] = f"""WITH {ctx_cte(False)},
{ordinal_split('ctx', 'row_id', 'label', T.SPLIT_SEED, T.TRAIN_SIZE)},
el AS (SELECT {", ".join(f"rw{k}" for k in range(CFG.k))}, CAST(unnest(embedding) AS DOUBLE) AS x,
              generate_subscripts(embedding, 1) - 1 AS i FROM split_rows WHERE split = 'train'),
sums AS ({" UNION ALL ".join(f"SELECT {k} AS arm_idx, i, sum(rw{k} * x) AS b FROM el GROUP BY i" for k in range(CFG.k))})
SELECT arm_idx, CAST(i AS INTEGER) AS i, round(b, 9) AS b FROM sums"""

SQL["q17_discounted_stats"] = f"""
WITH ev AS (
  SELECT event_type AS arm, value / 100.0 AS x0, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS r,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS ord,
         count(*) OVER (PARTITION BY event_type) AS n
  FROM events),
w AS (SELECT *, pow({dbl(Q.DISC_GAMMA)}, CAST(n - ord AS DOUBLE)) AS w FROM ev),
agg AS (SELECT arm, max(n) AS n, sum(w * x0 * x0) AS s00, sum(w * x0) AS s01, sum(w) AS s11,
               sum(w * r * x0) AS b0, sum(w * r) AS b1 FROM w GROUP BY arm)
SELECT arm, n,
  round(s00 + {dbl(Q.DISC_LAM)} * pow({dbl(Q.DISC_GAMMA)}, CAST(n AS DOUBLE)), 9) AS a00,
  round(s01, 9) AS a01,
  round(s11 + {dbl(Q.DISC_LAM)} * pow({dbl(Q.DISC_GAMMA)}, CAST(n AS DOUBLE)), 9) AS a11,
  round(b0, 9) AS b0, round(b1, 9) AS b1
FROM agg"""

SQL["q18_ucb_scores_2d"] = f"""WITH {route2d_ctes()}
SELECT row_id, CAST(arm_idx AS INTEGER) AS arm_idx, round(ucb, 9) AS ucb FROM scores"""

SQL["q19_route_2d"] = f"""WITH {route2d_ctes()}
SELECT row_id, CAST(arm_idx AS INTEGER) AS arm_idx, arm, round(ucb, 9) AS ucb, correct, price FROM outcomes"""

SQL["q21_policy_eval"] = f"""WITH {route2d_ctes()}
SELECT count(*) AS n, round(sum(coalesce(correct, 0)) / count(*), 9) AS accuracy,
       round(sum(price), 9) AS total_price, round(sum(price) / count(*) * 10000.0, 9) AS price_per_10k
FROM outcomes"""

SQL["q22_arm_mix"] = f"""WITH {route2d_ctes()}
SELECT CAST(arm_idx AS INTEGER) AS arm_idx, arm, count(*) AS n_chosen FROM outcomes GROUP BY arm_idx, arm"""

SQL["q23_progressive_metrics"] = f"""WITH {route2d_ctes()},
o AS (SELECT *, md5('{Q.ORDER_SEED}:' || CAST(row_id AS VARCHAR)) AS h FROM outcomes)
SELECT row_id, row_number() OVER w AS step,
       round(sum(coalesce(correct, 0)) OVER w / row_number() OVER w, 9) AS running_accuracy,
       round(sum(price) OVER w, 9) AS running_price
FROM o WINDOW w AS (ORDER BY h, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _hot(d: int) -> str:
    # one-hot contexts keep A diagonal: each arm is two lists of d numbers
    return f"SELECT *, CAST(event_id % {d} AS INTEGER) + 1 AS j FROM ({_learn_events()})"


def _step(old: str, arm: int, add: str) -> str:
    """A diagonal (or b) after one row of ``arm``: all discounted, one raised."""
    return (f"CASE WHEN arm_idx = {arm} THEN list_transform({old}, lambda v, i: {dbl(LC.gamma)} * v + "
            f"CASE WHEN i = j THEN {add} ELSE 0.0 END) ELSE {old} END")


SQL["q24_learn_by_key"] = f"""
WITH RECURSIVE ev AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM ({_hot(Q.KEYED_D)})),
run(user_id, step, event_id, arm_idx, ucb, reward, a0, b0, a1, b1) AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE),
         CAST(NULL AS DOUBLE), list_transform(range({Q.KEYED_D}), lambda i: {dbl(LC.lam)}), list_transform(range({Q.KEYED_D}), lambda i: 0.0::DOUBLE),
         list_transform(range({Q.KEYED_D}), lambda i: {dbl(LC.lam)}), list_transform(range({Q.KEYED_D}), lambda i: 0.0::DOUBLE)
  FROM ev
  UNION ALL
  SELECT user_id, step, event_id, arm_idx, ucb, reward, {_step('a0', 0, 'x * x')}, {_step('b0', 0, 'reward * x')},
         {_step('a1', 1, 'x * x')}, {_step('b1', 1, 'reward * x')}
  FROM (
    SELECT s.*, CASE WHEN u1 > u0 THEN 1 ELSE 0 END AS arm_idx,
           CASE WHEN u1 > u0 THEN u1 ELSE u0 END AS ucb,
           CASE WHEN u1 > u0 THEN r1 ELSE r0 END AS reward
    FROM (
      SELECT r.user_id, e.step, e.event_id, e.x, e.j, e.r0, e.r1, r.a0, r.b0, r.a1, r.b1,
             {_u('r.a0[e.j]', 'r.b0[e.j]', 'e.x')} AS u0, {_u('r.a1[e.j]', 'r.b1[e.j]', 'e.x')} AS u1
      FROM run r JOIN ev e ON e.user_id = r.user_id AND e.step = r.step + 1) s) t)
SELECT event_id, user_id, arm_idx, round(ucb, 9) AS ucb, reward FROM run WHERE step > 0"""


def _fold(old: str, arm: int, what: str) -> str:
    """The list after a day: the old one discounted once per row of the arm,
    plus the day's discounted sums by position."""
    n = f"sum(CASE WHEN arm_idx = {arm} THEN 1 ELSE 0 END)"
    rows = f"list(CASE WHEN arm_idx = {arm} THEN {{'j': j, 's': w * {what}}} END)"
    return (f"list_transform(any_value({old}), lambda v, i: pow({dbl(Q.BATCH_CFG.gamma)}, {n}) * v + "
            f"coalesce(list_sum(list_transform(list_filter({rows}, lambda e: e.j = i), lambda e: e.s)), 0.0))")


def _microbatch(batch: str) -> str:
    """CTEs up to ``e``: every event with the scores of both arms under the state before its batch."""
    return f"""
WITH RECURSIVE ev AS (
  SELECT *, {batch} AS day, dense_rank() OVER (ORDER BY {batch}) AS dstep
  FROM ({_hot(Q.BATCH_D)})),
st(dstep, a0, b0, a1, b1) AS (
  SELECT CAST(0 AS BIGINT), list_transform(range({Q.BATCH_D}), lambda i: {dbl(LC.lam)}), list_transform(range({Q.BATCH_D}), lambda i: 0.0::DOUBLE),
         list_transform(range({Q.BATCH_D}), lambda i: {dbl(LC.lam)}), list_transform(range({Q.BATCH_D}), lambda i: 0.0::DOUBLE)
  UNION ALL
  SELECT any_value(dstep), {_fold('a0', 0, 'x * x')}, {_fold('b0', 0, 'reward * x')},
         {_fold('a1', 1, 'x * x')}, {_fold('b1', 1, 'reward * x')}
  FROM (
    SELECT d.*, pow({dbl(Q.BATCH_CFG.gamma)}, CAST(count(*) OVER (PARTITION BY arm_idx ORDER BY ts, event_id
                 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS DOUBLE)) AS w
    FROM (
      SELECT e.dstep, e.ts, e.event_id, e.x, e.j, s.a0, s.b0, s.a1, s.b1,
             CASE WHEN {_u('s.a1[e.j]', 's.b1[e.j]', 'e.x')} > {_u('s.a0[e.j]', 's.b0[e.j]', 'e.x')} THEN 1 ELSE 0 END AS arm_idx,
             CASE WHEN {_u('s.a1[e.j]', 's.b1[e.j]', 'e.x')} > {_u('s.a0[e.j]', 's.b0[e.j]', 'e.x')} THEN e.r1 ELSE e.r0 END AS reward
      FROM st s JOIN ev e ON e.dstep = s.dstep + 1) d) z
  GROUP BY dstep),
e AS (SELECT e.*, {_u('s.a0[e.j]', 's.b0[e.j]', 'e.x')} AS u0, {_u('s.a1[e.j]', 's.b1[e.j]', 'e.x')} AS u1
      FROM ev e JOIN st s ON s.dstep = e.dstep - 1)
SELECT event_id, day, CASE WHEN u1 > u0 THEN 1 ELSE 0 END AS arm_idx,
       round(CASE WHEN u1 > u0 THEN u1 ELSE u0 END, 6) AS ucb,
       CASE WHEN u1 > u0 THEN r1 ELSE r0 END AS reward
FROM e"""


SQL["q25_learn_microbatch"] = _microbatch("strftime(ts, '%Y-%m-%d')")

SQL["q26_repeat_mean"] = f"""WITH {route2d_ctes()},
runs AS (SELECT r.run, o.* FROM outcomes o CROSS JOIN range({Q.REPEATS}) r(run)),
per_run AS (SELECT run, sum(coalesce(correct, 0)) / count(*) AS accuracy, sum(price) / count(*) * 10000.0 AS p10k
            FROM runs GROUP BY run)
SELECT count(*) AS runs, round(avg(accuracy), 9) AS mean_accuracy, round(avg(p10k), 9) AS mean_price_per_10k
FROM per_run"""

SQL["q27_model_registry"] = f"""
WITH conv AS (SELECT DISTINCT conv_id FROM conversations),
req AS (SELECT conv_id, ([{", ".join(lit(s) for s in Q.MODEL_REQUESTS)}])[conv_id % {len(Q.MODEL_REQUESTS)} + 1] AS request
        FROM conv),
ex AS (SELECT conv_id, unnest(string_split(request, ',')) AS model FROM req)
SELECT ex.model, r.model_id, string_split(r.model_id, '/')[-1] AS model_name, count(*) AS n_requests
FROM ex JOIN {REGISTRY} r USING (model) GROUP BY ALL"""

SQL["q28_normalised_price"] = f"""
WITH a AS (SELECT *, price / max(price) OVER () AS norm_price FROM {ARMS}),
c AS (SELECT count(*) AS n, {", ".join(f"sum({_correct(k)}) AS c{k}" for k in range(CFG.k))} FROM embeddings)
SELECT a.arm_idx, a.arm, a.price, round(a.norm_price, 9) AS norm_price,
       CAST(CASE a.arm_idx {" ".join(f"WHEN {k} THEN c{k}" for k in range(CFG.k))} END AS BIGINT) AS n_correct, c.n
FROM a, c"""

SQL["q29_chosen_label"] = f"""WITH {route2d_ctes()}
SELECT row_id, CAST(arm_idx AS INTEGER) AS arm_idx, correct FROM outcomes"""

SQL["q30_assemble_vectors"] = """
WITH cut AS (
  SELECT vec_id, embedding,
    CAST(CASE WHEN n // 4 = 0 THEN 4 ELSE least((rn - 1) // (n // 4) + 1, 4) END AS INTEGER) AS part
  FROM (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS rn, count(*) OVER () AS n FROM embeddings))
SELECT vec_id, part, row_number() OVER (ORDER BY part, vec_id) - 1 AS pos, CAST(len(embedding) AS INTEGER) AS dim,
       round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))), 9) AS l2
FROM cut"""

SQL["q31_scored_responses"] = f"""WITH {GRADED}
SELECT model, task, round(avg(correct), 9) AS accuracy, count(*) AS n FROM graded GROUP BY model, task"""

SQL["q32_embed_documents"] = f"""
WITH toks AS (
  SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\x{{0B}}\\x{{0C}}]+')) AS t FROM documents),
counts AS (
  SELECT doc_id, CAST(CAST(('0x' || substr(md5(t), 1, 4)) AS INTEGER) % {Q.HASH_DIM} AS INTEGER) AS bucket,
         count(*) AS cnt
  FROM toks WHERE length(t) > 0 GROUP BY ALL)
SELECT doc_id, bucket, round(cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY doc_id)), 9) AS weight FROM counts"""

SQL["q33_gram_poly3"] = f"""WITH {ctx_cte(False)},
{ordinal_split('ctx', 'row_id', 'label', T.SPLIT_SEED, T.TRAIN_SIZE)},
feat AS (
  SELECT row_id, list_concat(list_concat(d, list_transform(d, lambda v: pow(v, 2.0))),
                             list_transform(d, lambda v: pow(v, 3.0))) AS z
  FROM (SELECT row_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS d
        FROM split_rows WHERE split = 'train')),
el AS (SELECT row_id, unnest(z) AS x, generate_subscripts(z, 1) - 1 AS i FROM feat),
pairs AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS s FROM el a JOIN el b ON a.row_id = b.row_id AND b.i >= a.i
          GROUP BY a.i, b.i)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
       round(s + CASE WHEN i = j THEN {dbl(CFG.lam)} ELSE 0.0 END, 9) AS a FROM pairs"""


def _route64_sql() -> str:
    d, k = 64, CFG.k
    lam = dbl(CFG.lam)
    bcols = " UNION ALL ".join(
        f"SELECT i AS r, {d + j} AS c, sum(rw{j} * x) AS v FROM el GROUP BY i" for j in range(k))
    corr = ", ".join(f"c{j}" for j in range(k))
    return f"""
WITH RECURSIVE {ctx_cte(False)},
{ordinal_split('ctx', 'row_id', 'label', T.SPLIT_SEED, T.TRAIN_SIZE)},
el AS (SELECT row_id, {", ".join(f"rw{j}" for j in range(k))}, CAST(unnest(embedding) AS DOUBLE) AS x,
              generate_subscripts(embedding, 1) - 1 AS i FROM split_rows WHERE split = 'train'),
val AS (SELECT row_id, embedding, {corr}, row_number() OVER (ORDER BY row_id) - 1 AS vi
        FROM split_rows WHERE split = 'validation'),
vel AS (SELECT row_id, vi, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i
        FROM val),
aug AS (
  SELECT a.i AS r, b.i AS c, sum(a.x * b.x) + CASE WHEN a.i = b.i THEN {lam} ELSE 0.0 END AS v
  FROM el a JOIN el b USING (row_id) GROUP BY a.i, b.i
  UNION ALL {bcols}
  UNION ALL SELECT i AS r, {d + k} + vi AS c, x AS v FROM vel),
gj(s, r, c, v) AS (
  SELECT 0, r, c, v FROM aug
  UNION ALL
  SELECT s + 1, r, c, CASE WHEN r = s THEN v / piv ELSE v - rf * pr / piv END
  FROM (SELECT s, r, c, v,
               max(CASE WHEN r = s AND c = s THEN v END) OVER () AS piv,
               max(CASE WHEN c = s THEN v END) OVER (PARTITION BY r) AS rf,
               max(CASE WHEN r = s THEN v END) OVER (PARTITION BY c) AS pr
        FROM gj WHERE s < {d}) t),
sol AS (SELECT r, c, v FROM gj WHERE s = {d}),
theta AS (SELECT c - {d} AS arm_idx, r AS i, v AS t FROM sol WHERE c >= {d} AND c < {d + k}),
ainvx AS (SELECT c - {d + k} AS vi, r AS i, v AS z FROM sol WHERE c >= {d + k}),
mean AS (SELECT e.row_id, th.arm_idx, sum(th.t * e.x) AS m FROM vel e JOIN theta th USING (i)
         GROUP BY e.row_id, th.arm_idx),
var AS (SELECT e.row_id, sum(e.x * z.z) AS q FROM vel e JOIN ainvx z ON z.vi = e.vi AND z.i = e.i GROUP BY e.row_id),
scores AS (SELECT m.row_id, m.arm_idx, m.m + {dbl(CFG.alpha)} * sqrt(var.q) AS ucb FROM mean m JOIN var USING (row_id)),
chosen AS (SELECT row_id, arm_idx, ucb FROM (
             SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY ucb DESC, arm_idx) AS rk FROM scores) WHERE rk = 1),
outcomes AS (
  SELECT c.row_id, c.arm_idx, a.arm, c.ucb,
         CASE c.arm_idx {" ".join(f"WHEN {j} THEN v.c{j}" for j in range(k))} END AS correct, a.price
  FROM chosen c JOIN val v USING (row_id) LEFT JOIN {ARMS} a USING (arm_idx))
SELECT row_id, CAST(arm_idx AS INTEGER) AS arm_idx, arm, round(ucb, 6) AS ucb, correct, price FROM outcomes"""


SQL["q20_route_64d"] = _route64_sql()

SQL["q34_csv_by_name"] = f"""
SELECT concat_ws(',', {", ".join(f"c{k}" for k in range(CFG.k))}) AS value, CAST(NULL AS INTEGER) AS answer, count(*) AS n
FROM (SELECT {", ".join(f"{_correct(k)} AS c{k}" for k in range(CFG.k))} FROM embeddings) GROUP BY ALL
UNION ALL
SELECT md5(text) AS value, CAST(turn % 4 AS INTEGER) AS answer, count(*) AS n FROM conversations GROUP BY ALL"""

SQL["q35_prepare_vectors"] = f"""
SELECT t.task, b.item_id AS row_id, CASE WHEN n <= 4 THEN {Q.HASH_DIM} END AS dim,
       CASE WHEN n > 4 THEN 'more than four choices' END AS error
FROM (SELECT item_id, len(string_split(text, '. ')) AS n FROM benchmark) b JOIN {TASKS} t ON t.task_idx = b.item_id % 57"""

SQL["q36_failing_scorer"] = """
SELECT 'phi 2B' AS model, d.source AS task, CAST(NULL AS DOUBLE) AS accuracy, count(*) AS n, 'DeviceLost: no device' AS error
FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source"""

SQL["q37_pair_labels"] = """
SELECT count(e.vec_id) FILTER (l.doc_id IS NOT NULL) AS n,
       CAST(sum(l.quality) FILTER (e.vec_id IS NOT NULL) AS BIGINT) AS n_good,
       count(*) FILTER (e.vec_id IS NULL) AS labels_unmatched, count(*) FILTER (l.doc_id IS NULL) AS vectors_unmatched
FROM embeddings e FULL JOIN labels l ON e.vec_id = l.doc_id"""

SQL["q38_split_data"] = f"""WITH ctx AS (
  SELECT vec_id AS row_id, 'task ' || label AS task, {", ".join(f"{_correct(k)} AS {a}" for k, a in enumerate(CFG.arms))} FROM embeddings),
{ordinal_split('ctx', 'row_id', 'task', 1010, 0.75)}
SELECT row_id, task, {", ".join(CFG.arms)}, split FROM split_rows"""

SQL["q39_odd_rows"] = " UNION ALL ".join(f"""
SELECT * FROM (
  SELECT {d} AS d, CAST(i - 1 AS INTEGER) AS i, round(sum(x * x) + 12.94::DOUBLE, 6) AS a,
         {", ".join(f"round(sum(CASE WHEN vec_id % 7 <> {k} THEN x * CAST({_correct(k)} AS DOUBLE) ELSE 0.0 END), 6) AS b{k}" for k in range(CFG.k))}
  FROM (SELECT vec_id, label, i, v[i] AS x FROM (
    SELECT vec_id, label, {v} AS v, unnest(range(1, {d} + 1)) AS i FROM embeddings WHERE vec_id % 17 <> 0 AND vec_id % 19 <> 0))
  GROUP BY i), (SELECT count(*) AS n_no_arm FROM embeddings WHERE vec_id % 17 = 0 OR vec_id % 19 = 0)"""
    for d, v in (
        (2, "[list_sum([CAST(y AS DOUBLE) FOR y, k IN embedding IF k % 2 = 1]), list_sum([CAST(y AS DOUBLE) FOR y, k IN embedding IF k % 2 = 0])]"),
        (64, "list_transform(embedding, lambda y: CAST(y AS DOUBLE))"),
        (192, "list_concat(list_concat(list_transform(embedding, lambda y: CAST(y AS DOUBLE)), list_transform(embedding, lambda y: "
              "pow(CAST(y AS DOUBLE), 2))), list_transform(embedding, lambda y: pow(CAST(y AS DOUBLE), 3)))")))


ARRIVAL = "CAST(least((day(ts) - 1) // 8, 3) AS INTEGER)"

# A stream gives what its batch operator gives: arrivals are parts of the month.
SQL["q42_stream_by_key"] = SQL["q24_learn_by_key"]

SQL["q43_stream_microbatch"] = f"SELECT event_id, day AS arrival, arm_idx, ucb, reward FROM ({_microbatch(ARRIVAL)})"

SQL["q44_stream_scores"] = f"""WITH {route2d_ctes()}
SELECT row_id, CAST(arm_idx AS INTEGER) AS arm_idx, round(ucb, 9) AS ucb FROM outcomes"""

SQL["q45_stream_metrics"] = f"""WITH {route2d_ctes()}
SELECT CAST(a.arrival AS INTEGER) AS arrival, CAST(arm_idx AS INTEGER) AS arm_idx, count(*) AS n,
       round(sum(coalesce(correct, 0)) / count(*), 9) AS running_accuracy, round(sum(price), 9) AS running_price
FROM outcomes JOIN range(4) a(arrival) ON row_id % 4 <= a.arrival GROUP BY ALL"""

# Two positions of 512 meet in a row: the solve falls apart into 256 pairs.
HALF = Q.WIDE_D // 2
SQL["q41_solve_512"] = f"""
WITH ev AS (SELECT event_id % {HALF} AS j, x, hour(ts) / 24.0 AS y, r0, r1 FROM ({_learn_events()}) JOIN (SELECT event_id, ts FROM events) USING (event_id, ts)),
s AS (
  SELECT p.j, {dbl(LC.lam)} + coalesce(sum(x * x), 0) AS a, coalesce(sum(x * y), 0) AS c, {dbl(LC.lam)} + coalesce(sum(y * y), 0) AS b,
         {", ".join(f"coalesce(sum(r{k} * {v}), 0) AS {v}{k}" for k in range(2) for v in "xy")}
  FROM range({HALF}) p(j) LEFT JOIN ev USING (j) GROUP BY p.j),
d AS (SELECT *, a * b - c * c AS det FROM s)
SELECT arm_idx, i, round(theta, 6) AS theta, round(spread, 6) AS spread FROM (
  {" UNION ALL ".join(f"SELECT {k} AS arm_idx, CAST(j AS INTEGER) AS i, (b * x{k} - c * y{k}) / det AS theta, b / det AS spread FROM d"
                      f" UNION ALL SELECT {k}, CAST(j + {HALF} AS INTEGER), (a * y{k} - c * x{k}) / det, a / det FROM d" for k in range(2))})"""


def _repeats_sql() -> str:
    """Three runs of the learner over the validation contexts, in batches of
    250 rows of a seeded order; every arm's 2 x 2 state is three numbers, its
    reward sums two. No row is discounted (gamma is 1)."""
    k = CFG.k
    state = [f"{n}{m}" for m in range(k) for n in ("p", "q", "s", "u", "v")]
    det = [f"(st.p{m} * st.s{m} - st.q{m} * st.q{m})" for m in range(k)]
    score = [f"((st.s{m} * st.u{m} - st.q{m} * st.v{m}) * e.x0 + (st.p{m} * st.v{m} - st.q{m} * st.u{m}) * e.x1) / {det[m]} + {dbl(CFG.alpha)}"
             f" * sqrt((st.s{m} * e.x0 * e.x0 - 2 * st.q{m} * e.x0 * e.x1 + st.p{m} * e.x1 * e.x1) / {det[m]})" for m in range(k)]
    add = {"p": "x0 * x0", "q": "x0 * x1", "s": "x1 * x1", "u": "x0 * reward", "v": "x1 * reward"}
    best = lambda col: "CASE " + " ".join(
        f"WHEN {' AND '.join(f'w{m} >= w{o}' for o in range(k) if o != m)} THEN {col.format(m=m)}" for m in range(k)) + " END"
    first = ", ".join(f"{c} AS {n}{m}" for m in range(k) for n, c in zip(("p", "q", "s", "u", "v"), ("a00", "a01", "a11", f"z.b0_{m}", f"z.b1_{m}")))
    return f"""
WITH RECURSIVE {route2d_ctes()},
z AS (SELECT a00, a01, a11, {", ".join(f"max(CASE WHEN arm_idx = {m} THEN b{i} END) AS b{i}_{m}" for m in range(k) for i in range(2))}
      FROM bs, g GROUP BY a00, a01, a11),
e AS (SELECT r.run, v.row_id, v.x0, v.x1, {", ".join(f"c{m}, rw{m}" for m in range(k))},
             (row_number() OVER (PARTITION BY r.run ORDER BY md5('run' || r.run || ':' || v.row_id), v.row_id) - 1) // {Q.REPEAT_ROWS} + 1 AS step
      FROM val v, range({Q.REPEATS}) r(run)),
st AS (
  SELECT r.run, CAST(0 AS BIGINT) AS step, {first} FROM z, range({Q.REPEATS}) r(run)
  UNION ALL
  SELECT run, any_value(step), {", ".join(f"any_value({c}) + sum(CASE WHEN arm_idx = {c[1:]} THEN {add[c[0]]} ELSE 0.0 END)" for c in state)}
  FROM (SELECT *, {best('{m}')} AS arm_idx, {best('rw{m}')} AS reward FROM (
    SELECT e.run, e.step, e.x0, e.x1, {", ".join(f"rw{m}" for m in range(k))}, {", ".join(f"st.{c}" for c in state)},
           {", ".join(f"{score[m]} AS w{m}" for m in range(k))}
    FROM st JOIN e ON e.run = st.run AND e.step = st.step + 1)) GROUP BY run),
decided AS (SELECT run, {best('{m}')} AS arm_idx, {best('c{m}')} AS correct FROM (
  SELECT e.run, {", ".join(f"c{m}" for m in range(k))}, {", ".join(f"{score[m]} AS w{m}" for m in range(k))}
  FROM st JOIN e ON e.run = st.run AND e.step = st.step + 1))
SELECT CAST(run AS INTEGER) AS run, count(*) AS n, round(avg(correct), 9) AS accuracy, round(sum(price) / count(*) * 10000.0, 9) AS price_per_10k
FROM decided JOIN {ARMS} USING (arm_idx) GROUP BY run"""


SQL["q40_learning_repeats"] = _repeats_sql()


def _cut(src: str, group: str, key: str, order: str) -> str:
    return f"""
SELECT {key}, {group}, CAST(CASE WHEN n // 4 = 0 THEN 4 ELSE least((rn - 1) // (n // 4) + 1, 4) END AS INTEGER) AS part
FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY {group}) AS n FROM ({src}))"""


SQL["q46_cut_by_value"] = _cut("SELECT event_id, event_type, value FROM events", "event_type", "event_id", "value, event_id")

SQL["q47_cut_by_name"] = _cut("SELECT lang, 'doc_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS name FROM documents", "lang", "name", "name")

SQL["q48_last_token_embedding"] = """
SELECT conv_id, turn, padded_left, CASE WHEN len(w) > 0 THEN CAST(('0x' || substr(md5(w[-1]), 1, 4)) AS INTEGER) / 65536.0 END AS token,
       CASE WHEN len(w) > 0 THEN len(w) END AS n_tokens
FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x{0B}\\x{0C}]+'), lambda t: t <> '') AS w FROM conversations),
     (VALUES (true), (false)) s(padded_left)"""

SQL["q49_file_trees"] = f"""
WITH it AS (
  SELECT t.task, md5(b.text) AS text, b.item_id, len(string_split(b.text, '. ')) AS n,
         row_number() OVER (PARTITION BY t.task ORDER BY b.item_id) - 1 AS row_id
  FROM benchmark b JOIN {TASKS} t ON t.task_idx = b.item_id % {len(C.TASKS)})
SELECT 'prompt' AS kind, task, 'test' AS split, row_id, text, CAST(item_id % 4 AS INTEGER) AS n FROM it
UNION ALL SELECT 'question', task, 'auxiliary_train', row_id, text, CAST(n AS INTEGER) FROM it"""

SQL["q50_sinks_rerun"] = f"""WITH questions AS (
  SELECT conv_id * 1000 + turn AS row_id, 'task_' || (conv_id % 20) AS task, text AS prompt, CAST(turn % 4 AS INTEGER) AS answer
  FROM conversations WHERE role = 'user'),{GRADING}
SELECT 'tasks' AS sink, model, 'test' AS split, task, count(*) AS n, CAST(sum(correct) AS BIGINT) AS n_correct FROM graded GROUP BY model, task
UNION ALL SELECT 'whole', model, 'auxiliary_train', NULL, count(*), CAST(sum(correct) AS BIGINT) FROM graded GROUP BY model
UNION ALL SELECT 'summary', model, 'test', task, 1, CAST(sum(correct) AS BIGINT) FROM graded GROUP BY model, task"""
