"""DuckDB SQL for the catalogue, written from the definitions and apart from the Spark code."""

from __future__ import annotations

CTE = {
    "logits": "SELECT e.vec_id AS example_id, e.label, s.t AS step, list_transform(e.embedding[(10*s.t+1):(10*s.t+10)], lambda x: 10.0::DOUBLE * x::DOUBLE) AS z FROM embeddings e, (SELECT unnest(range(6)) AS t) s",
    "soft": "SELECT *, list_transform(ez, lambda x: x / es) AS p FROM (SELECT *, list_sum(ez) AS es FROM (SELECT *, list_transform(z, lambda x: exp(x - zm)) AS ez FROM (SELECT *, list_max(z) AS zm FROM logits)))",
    "point": """SELECT example_id, label, step, (list_position(z, zm) - 1 = label) AS acc, list_position(z, zm) - 1 AS pred,
        -list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) AS ent, p[label + 1] AS conf, list_max(p) AS maxconf,
        p[label + 1] - list_max(list_transform(p, lambda x, i: CASE WHEN i = label + 1 THEN 0 ELSE x END)) AS margin,
        sqrt(list_sum(list_transform(p, lambda x, i: (x - CASE WHEN i = label + 1 THEN 1 ELSE 0 END) * (x - CASE WHEN i = label + 1 THEN 1 ELSE 0 END)))) AS el2n, ln(es) + zm - z[label + 1] AS loss FROM soft""",
    "dense": "SELECT example_id, step, acc FROM point",
    "ragged": "SELECT user_id AS example_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value > 50 AS acc FROM events",
    "acts": "SELECT l.i AS layer_idx, e.vec_id AS example_id, e.label, list_transform(e.embedding[(16*l.i+1):(16*l.i+16)], lambda x: x::DOUBLE) AS act FROM embeddings e, (SELECT unnest(range(4)) AS i) l",
    "metrics": """SELECT CASE WHEN step < 3 THEN 'm0' ELSE 'm1' END AS model, step % 3 AS replicate, metric, example_id, value, (example_id + step % 3) % 2 = 0 AS is_train FROM
        (SELECT example_id, step, unnest(['acc', 'ent', 'conf', 'maxconf', 'margin', 'el2n']) AS metric, unnest([acc::INT::DOUBLE, ent, conf, maxconf, margin, el2n]) AS value FROM point)""",
    "three": """SELECT 'm' || (step // 2) AS model, step % 2 AS replicate, metric, example_id, round(value, 9) AS value FROM
        (SELECT example_id, step, unnest(['acc', 'ent', 'conf', 'maxconf', 'margin', 'el2n']) AS metric, unnest([acc::INT::DOUBLE, ent, conf, maxconf, margin, el2n]) AS value FROM point)""",
    "lin": """SELECT vec_id AS example_id, label, t AS step, list_transform(embedding, lambda x: x::DOUBLE) AS x, list_transform(range(10), lambda c: 1.0::DOUBLE +
        list_sum(list_transform(embedding, lambda v, j: v::DOUBLE * ((31*c + 17*(j-1) + 7*t) % 13 - 6)::DOUBLE / 13.0::DOUBLE))) AS z FROM embeddings, (SELECT unnest(range(6)) AS t)""",
    "linp": "SELECT example_id, label, step, x, z, list_transform(ez, lambda e: e / list_sum(ez)) AS p FROM (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS ez FROM lin)",
    "net0": f"SELECT vec_id AS example_id, label, t AS step, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(3)) AS t)",
    "net1": "SELECT *, list_transform(range(16), lambda o: ((7*o + step) % 5 - 2) / 10.0::DOUBLE + list_sum(list_transform(x, lambda v, i: v * ((31*o + 17*(i-1) + 7*step) % 13 - 6) / 13.0::DOUBLE))) AS a0 FROM net0",
    "net2": "SELECT *, list_transform(range(12), lambda o: ((7*o + 3 + step) % 5 - 2) / 10.0::DOUBLE + list_sum(list_transform(h0, lambda v, i: v * ((31*o + 17*(i-1) + 7*step + 5) % 13 - 6) / 13.0::DOUBLE))) AS a1 FROM (SELECT *, list_transform(a0, lambda v: greatest(v, 0)) AS h0 FROM net1)",
    "net3": "SELECT *, list_transform(range(10), lambda o: ((7*o + 6 + step) % 5 - 2) / 10.0::DOUBLE + list_sum(list_transform(h1, lambda v, i: v * ((31*o + 17*(i-1) + 7*step + 10) % 13 - 6) / 13.0::DOUBLE))) AS z FROM (SELECT *, list_transform(a1, lambda v: greatest(v, 0)) AS h1 FROM net2)",
    "netp": "SELECT *, list_transform(ez, lambda e: e / list_sum(ez)) AS p FROM (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS ez FROM net3)",
}
NEEDS = {"net1": ["net0"], "net2": ["net0", "net1"], "net3": ["net0", "net1", "net2"], "netp": ["net0", "net1", "net2", "net3"], "soft": ["logits"], "point": ["logits", "soft"], "dense": ["logits", "soft", "point"], "metrics": ["logits", "soft", "point"], "three": ["logits", "soft", "point"], "linp": ["lin"]}


def sql(names: str, body: str, **more: str) -> str:
    """``body`` after the named common tables and what they need; ``more`` adds tables of its own."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({s})" for n, s in more.items()]
    return f"WITH {', '.join(parts)} {body}"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0::DOUBLE"


MARKED = "SELECT *, coalesce(lag(acc) OVER (PARTITION BY example_id ORDER BY step), {start}) AS before FROM {source}"
FIRSTLEARN = "coalesce(min(step) FILTER (WHERE acc), count(*))::BIGINT"
FIRSTUNFORGETTABLE = "coalesce(max(step) FILTER (WHERE NOT acc) + 1, 0)::BIGINT"
FIRSTFORGET = "coalesce(min(step) FILTER (WHERE NOT acc), count(*))::BIGINT"
FIRSTUNLEARNABLE = "coalesce(max(step) FILTER (WHERE acc) + 1, 0)::BIGINT"
COUNT = "(count(*) FILTER (WHERE before AND NOT acc))::BIGINT"
UNFORGETTABLE = "(count(*) FILTER (WHERE before AND NOT acc)) = 0 AND bool_or(acc)"


def from_point(expr: str, name: str, round_it: bool = True) -> str:
    return sql("point", f"SELECT example_id, step, {r(expr) if round_it else expr} AS {name} FROM point")


def per_example(source: str, **columns: str) -> str:
    return sql(source, f"SELECT example_id, {', '.join(f'{c} AS {k}' for k, c in columns.items())} FROM {source} GROUP BY example_id")


def edges(source: str, start: bool, **columns: str) -> str:
    return sql(source, f"SELECT example_id, {', '.join(f'{c} AS {k}' for k, c in columns.items())} FROM marked GROUP BY example_id", marked=MARKED.format(start=str(start).lower(), source=source))


def segments(kept: str) -> str:
    """Stretches of steps without a gap, of the kept ones."""
    islands = f"SELECT *, step - row_number() OVER (PARTITION BY example_id ORDER BY step) AS island FROM ragged WHERE {kept}"
    before = "SELECT *, lag(acc) OVER (PARTITION BY example_id, island ORDER BY step) AS before FROM islands"
    body = """SELECT example_id, min(step) AS first, max(step) AS last, arg_min(acc, step) AS first_acc, arg_max(acc, step) AS last_acc, (count(*) FILTER (WHERE before AND NOT acc))::BIGINT AS forgets,
        min(step) FILTER (WHERE acc) AS first_right, max(step) FILTER (WHERE NOT acc) AS last_wrong FROM marked GROUP BY example_id, island"""
    return sql("ragged", body, islands=islands, marked=before)


METRIC_NAMES = ("acc", "ent", "conf", "maxconf", "margin", "el2n")
_NUM = {"acc": "acc::INT::DOUBLE"} | {m: m for m in METRIC_NAMES[1:]}
RANKED = "SELECT *, rank() OVER (PARTITION BY model, replicate, metric ORDER BY value) + (count(*) OVER (PARTITION BY model, replicate, metric, value) - 1) / 2.0::DOUBLE - 1 AS rnk FROM metrics"
BINS = """SELECT metric, model, example_id, value, CASE WHEN n > 1 THEN floor(place * 99 / (n - 1)) ELSE 0 END::INT AS bin FROM
    (SELECT *, row_number() OVER (PARTITION BY model, metric ORDER BY value, example_id) - 1 AS place, count(*) OVER (PARTITION BY model, metric) AS n FROM
        (SELECT model, metric, example_id, round(avg(value), 9) AS value FROM metrics GROUP BY ALL))"""
KNN = """SELECT layer_idx, query_id, label FROM (SELECT a.layer_idx, a.example_id AS query_id, b.label, row_number() OVER (PARTITION BY a.layer_idx, a.example_id ORDER BY list_distance(a.act, b.act), b.example_id) AS rn
    FROM {q} a JOIN {t} b ON a.layer_idx = b.layer_idx) WHERE rn <= {k}"""
VOTED = """SELECT v.layer_idx, v.query_id AS example_id, v.label AS pred, v.label = q.label AS match FROM (SELECT *, row_number() OVER (PARTITION BY layer_idx, query_id ORDER BY n DESC, label) AS rn FROM
    (SELECT layer_idx, query_id, label, count(*) AS n FROM near GROUP BY ALL)) v JOIN {q} q ON v.layer_idx = q.layer_idx AND v.query_id = q.example_id WHERE rn = 1"""
PROTO = """SELECT a.layer_idx, a.example_id, a.label, list_distance(a.act, c.center) AS proto FROM acts a JOIN
    (SELECT layer_idx, label, list(m ORDER BY pos) AS center FROM (SELECT layer_idx, label, pos, avg(v) AS m FROM (SELECT layer_idx, label, unnest(range(16)) AS pos, unnest(act) AS v FROM acts) GROUP BY ALL) GROUP BY ALL) c
    ON a.layer_idx = c.layer_idx AND a.label = c.label"""
W = "(((31*({c}) + 17*({j}) + 7*step) % 13 - 6)::DOUBLE / 13.0::DOUBLE)"
#: Input gradients of the class confidence and of the loss, one row a step, example and input.
CLASS_GRAD = f"""SELECT example_id, step, j, p[y + 1] * ({W.format(c='y', j='j')} - list_sum(list_transform(p, lambda q, c: q * {W.format(c='c - 1', j='j')}))) AS g FROM
    (SELECT *, unnest(range(64)) AS j FROM (SELECT *, {{y}} AS y FROM linp))"""
LOSS_GRAD = f"""SELECT example_id, step, j, list_sum(list_transform(p, lambda q, c: q * {W.format(c='c - 1', j='j')})) - {W.format(c='label', j='j')} AS g FROM (SELECT *, unnest(range(64)) AS j FROM linp)"""
VOG = "SELECT example_id, {v} AS vog FROM (SELECT example_id, px, var_samp(m) AS v FROM (SELECT example_id, step, j % 16 AS px, avg(g) AS m FROM grads GROUP BY ALL) GROUP BY ALL) GROUP BY example_id".replace("{v}", r("avg(v)", 9))
#: Errors of a layered model's modules, from that of the logits back to the inputs.
BACK = """SELECT *, list_transform(range(64), lambda i: list_sum(list_transform(d0, lambda d, o: d * ((31*(o-1) + 17*i + 7*step) % 13 - 6) / 13.0::DOUBLE))) AS dx FROM
    (SELECT *, list_transform(range(16), lambda i: CASE WHEN a0[i + 1] > 0 THEN list_sum(list_transform(d1, lambda d, o: d * ((31*(o-1) + 17*i + 7*step + 5) % 13 - 6) / 13.0::DOUBLE)) ELSE 0 END) AS d0 FROM
    (SELECT *, list_transform(range(12), lambda i: CASE WHEN a1[i + 1] > 0 THEN list_sum(list_transform(d2, lambda d, o: d * ((31*(o-1) + 17*i + 7*step + 10) % 13 - 6) / 13.0::DOUBLE)) ELSE 0 END) AS d1 FROM
    (SELECT *, {error} AS d2 FROM netp)))"""
LOSS_ERROR = "list_transform(p, lambda v, c: v - (c = {y} + 1)::INT)"
CONFIDENCE_ERROR = "list_transform(p, lambda v, c: p[{y} + 1] * ((c = {y} + 1)::INT - v))"
_SQ = "list_sum(list_transform({v}, lambda u: u * u))"
_PART = lambda d, x: f"{_SQ.format(v=d)} * ({_SQ.format(v=x)} + 1)"
CORR = "CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"
PAIRS = """SELECT model, replicate, metric_a, metric_b, {corr} AS corr FROM (SELECT a.model, a.replicate, a.metric AS metric_a, b.metric AS metric_b, a.{v} AS av, b.{v} AS bv FROM {t} a JOIN {t} b
    ON a.model = b.model AND a.example_id = b.example_id AND ((a.metric <> b.metric AND a.replicate = b.replicate) OR (a.metric = b.metric AND a.replicate < 1 AND b.replicate = a.replicate + 1))) GROUP BY ALL"""
#: Assignments of the run columns of each pair of models to two sides; -1 is the true one.
PERMS = """SELECT -1 AS perm, model_a, model_b, model, replicate, (model = model_b)::INT AS side FROM paired UNION ALL
    SELECT perm, model_a, model_b, model, replicate, CASE WHEN row_number() OVER (PARTITION BY model_a, model_b, perm ORDER BY key, c) <= of_a THEN 0 ELSE 1 END AS side FROM
    (SELECT *, ((perm * 7919 + c * 104729 + 1) * 48271) % 2147483647 * 16807 % 2147483647 AS key FROM paired, (SELECT unnest(range(100)) AS perm))"""
PAIRED = """SELECT *, count(*) FILTER (WHERE model = model_a) OVER (PARTITION BY model_a, model_b) AS of_a FROM
    (SELECT a.model AS model_a, b.model AS model_b FROM (SELECT DISTINCT model FROM {t}) a JOIN (SELECT DISTINCT model FROM {t}) b ON a.model < b.model)
    JOIN (SELECT *, dense_rank() OVER (ORDER BY model, replicate) AS c FROM (SELECT DISTINCT model, replicate FROM {t})) ON model = model_a OR model = model_b"""
DIFFS = "SELECT model_a, model_b, perm, metric, example_id, {f}({v}) FILTER (WHERE side = 0) - {f}({v}) FILTER (WHERE side = 1) AS diff FROM {t} JOIN perms USING (model, replicate) GROUP BY ALL"


def permuted(source: str, table: str, keys: str, norm: str, value: str = "value", f: str = "avg", nlogp: bool = False, **more: str) -> str:
    """Statistics of the true assignment by ``keys`` and the share of the others that are as large."""
    keyed = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    shown = ", ".join(f"a.{k}" for k in keys.split(", "))
    tests = f"SELECT {shown}, any_value(a.norm) AS stat, avg((b.norm >= a.norm)::INT) AS p FROM norms a JOIN norms b ON {keyed} WHERE a.perm = -1 AND b.perm <> -1 GROUP BY {shown}"
    body = f"SELECT {keys}, {r('stat')} AS stat, {r('p')} AS p{', ' + r('-ln(p + 1e-8)') + ' AS nlogp' if nlogp else ''} FROM tests"
    return sql(source, body, **more, paired=PAIRED.format(t=table), perms=PERMS, diffs=DIFFS.format(f=f, v=value, t=table), norms=f"SELECT perm, {keys}, round({norm}, 9) AS norm FROM diffs GROUP BY ALL", tests=tests)


SCALED = "SELECT model, replicate, metric, example_id, CASE WHEN sd > 0 THEN (value - mean) / sd ELSE value - mean END AS value FROM (SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd FROM three WINDOW w AS (PARTITION BY model, replicate, metric))"
REDUCTIONS = ", ".join(f"{r(f'{f}(value) FILTER (WHERE {c})')} AS {n}_{k}" for n, c in (("all", "true"), ("train", "is_train"), ("test", "NOT is_train")) for k, f in (("mean", "avg"), ("median", "median")))
STEPPED = lambda f, p: ", ".join(f"{r(f'{f}({_NUM[m]})')} AS {p}_{m}" for m in METRIC_NAMES)

#: Eigenvalues of each model's 5 x 5 correlation matrix, by cyclic Jacobi rotations of a list of 25 numbers.
_AT = lambda i, j: f"m[5 * ({i}) + ({j}) + 1]"
_TURN = f"""CASE WHEN abs({_AT('p', 'q')}) < 1e-300 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE * atan2(2 * {_AT('p', 'q')}, {_AT('q', 'q')} - {_AT('p', 'p')}) END"""
_COLUMNS = "list_transform(range(25), lambda k: CASE WHEN k % 5 = p THEN cos(t) * m[k // 5 * 5 + p + 1] - sin(t) * m[k // 5 * 5 + q + 1] WHEN k % 5 = q THEN sin(t) * m[k // 5 * 5 + p + 1] + cos(t) * m[k // 5 * 5 + q + 1] ELSE m[k + 1] END)"
_ROWS = "list_transform(range(25), lambda k: CASE WHEN k // 5 = p THEN cos(t) * c[p * 5 + k % 5 + 1] - sin(t) * c[q * 5 + k % 5 + 1] WHEN k // 5 = q THEN sin(t) * c[p * 5 + k % 5 + 1] + cos(t) * c[q * 5 + k % 5 + 1] ELSE c[k + 1] END)"
PCA = sql(
    "metrics", f"""SELECT model, component, {r('ratio')} AS ratio, {r('cumulative')} AS cumulative, cumulative - ratio <= 0.99 AS kept FROM
        (SELECT *, sum(ratio) OVER (PARTITION BY model ORDER BY component) AS cumulative FROM (SELECT model, (row_number() OVER (PARTITION BY model ORDER BY v DESC) - 1)::INT AS component, v / 5 AS ratio FROM
            (SELECT model, unnest([m[1], m[7], m[13], m[19], m[25]]) AS v FROM turned WHERE step = 100)))""",
    means="SELECT model, metric, example_id, avg(value) AS value FROM metrics WHERE metric <> 'acc' GROUP BY ALL",
    matrices=f"SELECT model, list(v ORDER BY ma, mb) AS m FROM (SELECT a.model, a.metric AS ma, b.metric AS mb, {CORR.format(a='a.value', b='b.value')} AS v FROM means a JOIN means b ON a.model = b.model AND a.example_id = b.example_id GROUP BY ALL) GROUP BY model",
    **{"turned(model, step, m)": f"""SELECT model, 0, m FROM matrices UNION ALL SELECT model, step + 1, {_ROWS} FROM (SELECT *, {_COLUMNS} AS c FROM (SELECT *, {_TURN} AS t FROM
        (SELECT *, [0, 0, 0, 0, 1, 1, 1, 2, 2, 3][step % 10 + 1] AS p, [1, 2, 3, 4, 2, 3, 4, 3, 4, 4][step % 10 + 1] AS q FROM turned WHERE step < 100)))"""},
).replace("WITH ", "WITH RECURSIVE ", 1)

ORACLES: dict[str, str] = {
    "pca_explained_variance": PCA,
    "softmax": sql("soft", f"SELECT example_id, step, c - 1 AS class_idx, {r('p[c]')} AS p FROM (SELECT *, unnest(range(1, 11)) AS c FROM soft)"),
    "zero_one_accuracy": from_point("acc", "acc", False), "entropy": from_point("ent", "ent"), "class_confidence": from_point("conf", "conf"), "max_confidence": from_point("maxconf", "maxconf"),
    "margin": from_point("margin", "margin"), "el2n": from_point("el2n", "el2n"), "cross_entropy": from_point("loss", "cross_entropy"),
    "pointwise_metrics": sql("point", f"SELECT example_id, label, step, acc, {', '.join(f'{r(m)} AS {m}' for m in (*METRIC_NAMES[1:], 'loss'))} FROM point"),
    "evaluate_linear_model": sql("linp", f"SELECT example_id, step, list_position(z, list_max(z)) - 1 = label AS acc, {r('ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) + list_max(z) - z[label + 1]')} AS loss FROM linp"),
    "vector_norms": f"SELECT vec_id AS example_id, {r('sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))')} AS l2, {r('list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))')} AS linf, {r('list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE) ** 3)) ** (1.0::DOUBLE / 3)')} AS l3 FROM embeddings",
    "one_hot_labels": "SELECT vec_id AS example_id, c AS class_idx, (c = label)::INT AS hot FROM embeddings, (SELECT unnest(range(10)) AS c)",
    "mean_color_channels": f"SELECT vec_id AS example_id, px AS pixel, {r('(embedding[px+1]::DOUBLE + embedding[px+17]::DOUBLE + embedding[px+33]::DOUBLE + embedding[px+49]::DOUBLE) / 4')} AS mean FROM embeddings, (SELECT unnest(range(16)) AS px)",
    "mean_pixels": f"SELECT vec_id AS example_id, {r('list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64')} AS mean FROM embeddings",
    "forgetting_events": sql("ragged", "SELECT example_id, step, acc, before AND NOT acc AS forgot FROM marked", marked=MARKED.format(start="false", source="ragged")),
    "learning_events": sql("ragged", "SELECT example_id, step, acc, NOT before AND acc AS learned FROM marked", marked=MARKED.format(start="false", source="ragged")),
    "first_learn": per_example("ragged", firstlearn=FIRSTLEARN), "first_unforgettable": per_example("ragged", firstunforgettable=FIRSTUNFORGETTABLE),
    "first_forget": per_example("ragged", firstforget=FIRSTFORGET), "first_unlearnable": per_example("ragged", firstunlearnable=FIRSTUNLEARNABLE),
    "count_forgetting_from0": edges("ragged", False, countforget=COUNT), "count_forgetting_from1": edges("ragged", True, countforget=COUNT),
    "is_unforgettable_from0": edges("ragged", False, unforgettable=UNFORGETTABLE), "is_unforgettable_from1": edges("ragged", True, unforgettable=UNFORGETTABLE),
    "last_event_time": sql("ragged", "SELECT example_id, coalesce(max(step) FILTER (WHERE before AND NOT acc), count(*))::BIGINT AS last_forget FROM marked GROUP BY example_id", marked=MARKED.format(start="false", source="ragged")),
    "forget_metrics_from0": edges("dense", False, countforget=COUNT, unforgettable=UNFORGETTABLE, firstlearn=FIRSTLEARN, firstunforgettable=FIRSTUNFORGETTABLE),
    "forget_metrics_from1": edges("dense", True, countforget=COUNT, unforgettable=UNFORGETTABLE, firstforget=FIRSTFORGET, firstunlearnable=FIRSTUNLEARNABLE),
    "forget_metrics_ragged": edges("ragged", False, countforget=COUNT, unforgettable=UNFORGETTABLE, firstlearn=FIRSTLEARN, firstunforgettable=FIRSTUNFORGETTABLE),
    "mean_over_steps": sql("point", f"SELECT example_id, {STEPPED('avg', 'avg')} FROM point GROUP BY example_id"),
    "variance_over_steps": sql("point", f"SELECT example_id, {STEPPED('var_samp', 'var')} FROM point GROUP BY example_id"),
    "online_pointwise": sql("point", f"SELECT label, count(*) AS n, {STEPPED('avg', 'avg')}, {STEPPED('var_samp', 'var')} FROM point GROUP BY label"),
    "resume_variance": sql("metrics", f"SELECT metric, example_id, count(*)::BIGINT AS n, {r('avg(value)')} AS mean, {r('var_samp(value)')} AS variance FROM metrics GROUP BY metric, example_id"),
    "last_metrics": sql("point", f"SELECT example_id, {', '.join(f'{r(m)} AS last_{m}' for m in METRIC_NAMES[1:])} FROM point WHERE step = 5"),
    "ensemble_accuracy": sql("point", f"SELECT example_id, {r('avg(acc::INT)')} AS allacc FROM point GROUP BY example_id"),
    "always_never_learned": sql("point", "SELECT example_id, bool_and(acc) AS always, NOT bool_or(acc) AS never FROM point GROUP BY example_id"),
    "ddd": sql("point", "SELECT example_id, CASE WHEN bool_and(acc) THEN 1 WHEN NOT bool_or(acc) THEN -1 ELSE 0 END AS ddd FROM point GROUP BY example_id"),
    "consensus_label": sql("point", "SELECT example_id, pred AS consensuslabel, n AS n_votes FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY n DESC, pred) AS rn FROM (SELECT example_id, pred, count(*) AS n FROM point GROUP BY ALL)) WHERE rn = 1"),
    "ensemble_metrics": sql("point", f"SELECT p.example_id, CASE WHEN bool_and(acc) THEN 1 WHEN NOT bool_or(acc) THEN -1 ELSE 0 END AS ddd, {r('avg(acc::INT)')} AS allacc, any_value(c.pred) AS consensuslabel FROM point p JOIN (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY n DESC, pred) AS rn FROM (SELECT example_id, pred, count(*) AS n FROM point GROUP BY ALL)) c ON p.example_id = c.example_id AND rn = 1 GROUP BY p.example_id"),
    "rank_avg_ties": sql("metrics", f"SELECT model, replicate, metric, example_id, {r('rnk')} AS rank FROM ranked", ranked=RANKED.replace("ORDER BY value", "ORDER BY round(value, 9)").replace("metric, value)", "metric, round(value, 9))")),
    "rank_event_values": "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY v) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2.0::DOUBLE - 1 AS rank FROM (SELECT event_id, event_type, floor(value) AS v FROM events)",
    "argsort_runs": sql("metrics", "SELECT model, replicate, metric, row_number() OVER (PARTITION BY model, replicate, metric ORDER BY round(value, 9), example_id) - 1 AS rank, example_id FROM metrics"),
    "order_to_rank": sql("logits", "SELECT row_id, step, class_idx, row_number() OVER (PARTITION BY row_id, step ORDER BY v, class_idx) - 1 AS rank FROM (SELECT example_id AS row_id, step, unnest(range(10)) AS class_idx, round(unnest(z), 9) AS v FROM logits)"),
    "rank_bins": sql("metrics", "SELECT model, metric, example_id, bin FROM bins", bins=BINS),
    "binned_quantiles": sql("metrics", f"SELECT model, metric, bin, n, {r('mean')} AS mean, {r('median')} AS median, CASE WHEN metric <> 'acc' THEN {r('low')} END AS low, CASE WHEN metric <> 'acc' THEN {r('high')} END AS high, (sum(n) OVER (PARTITION BY model, metric ORDER BY bin))::BIGINT AS x FROM (SELECT m.model, m.metric, bin, count(*) AS n, avg(m.value) AS mean, median(m.value) AS median, quantile_cont(m.value, 0.05) AS low, quantile_cont(m.value, 0.95) AS high FROM metrics m JOIN bins USING (model, metric, example_id) GROUP BY ALL)", bins=BINS),
    "layer_filter": "SELECT l.i AS layer_idx, count(*) AS n FROM embeddings, (SELECT unnest([1, 2]) AS i) l GROUP BY ALL",
    "distinct_layers": "SELECT i AS layer_idx, CASE WHEN i % 2 = 1 THEN 'block' || i || '.out' ELSE 'block' || i || '.in' END AS layer, count(*) AS n FROM embeddings, (SELECT unnest(range(4)) AS i) GROUP BY ALL",
    "knn_predict": sql("acts", "SELECT * FROM voted", near=KNN.format(q="acts", t="acts", k=30), voted=VOTED.format(q="acts")),
    "knn_train_test": sql("acts", "SELECT * FROM voted", tr="SELECT * FROM acts WHERE example_id % 5 <> 0", te="SELECT * FROM acts WHERE example_id % 5 = 0", near=KNN.format(q="te", t="tr", k=30), voted=VOTED.format(q="te")),
    "prediction_depth": sql("acts", "SELECT example_id, coalesce(max(layer_idx) FILTER (WHERE NOT match) + 1, 0)::BIGINT AS pd FROM voted GROUP BY example_id", near=KNN.format(q="acts", t="acts", k=30), voted=VOTED.format(q="acts")),
    "prediction_depth_softmax_layer": sql("soft acts", "SELECT example_id, coalesce(max(layer_idx) FILTER (WHERE NOT match) + 1, 0)::BIGINT AS pd FROM voted GROUP BY example_id",
        every="SELECT * FROM acts UNION ALL SELECT 4 AS layer_idx, example_id, label, list_transform(p, lambda v: round(v, 9)) AS act FROM soft WHERE step = 5", near=KNN.format(q="every", t="every", k=30), voted=VOTED.format(q="every")),
    "supervised_prototypes": sql("acts", f"SELECT example_id, label, {r('proto')} AS proto FROM protos WHERE layer_idx = 3", protos=PROTO),
    "representation_metrics": sql("acts", f"SELECT p.example_id, p.label, {r('p.proto')} AS proto, d.pd, d.m0 AS pdlayer0, d.m1 AS pdlayer1, d.m2 AS pdlayer2, d.m3 AS pdlayer3 FROM protos p JOIN (SELECT example_id, coalesce(max(layer_idx) FILTER (WHERE NOT match) + 1, 0)::BIGINT AS pd, {', '.join(f'bool_or(match) FILTER (WHERE layer_idx = {i}) AS m{i}' for i in range(4))} FROM voted GROUP BY example_id) d USING (example_id) WHERE p.layer_idx = 3", protos=PROTO, near=KNN.format(q="acts", t="acts", k=30), voted=VOTED.format(q="acts")),
    "input_gradient": sql("linp", f"SELECT example_id, j AS pos, {r('avg(g)')} AS grad FROM grads GROUP BY ALL", grads=CLASS_GRAD.format(y="label")),
    "input_gradient_argmax": sql("linp", f"SELECT example_id, j AS pos, {r('avg(g)')} AS grad FROM grads GROUP BY ALL", grads=CLASS_GRAD.format(y="list_position(z, list_max(z)) - 1")),
    "variance_of_gradients_class": sql("linp", VOG, grads=CLASS_GRAD.format(y="label")), "variance_of_gradients_loss": sql("linp", VOG, grads=LOSS_GRAD), "online_variance_of_gradients": sql("linp", VOG, grads=CLASS_GRAD.format(y="label")),
    "grand_score": sql("linp", f"SELECT example_id, {r('avg(sqrt(list_sum(list_transform(p, lambda v, c: (v - (c = label + 1)::INT) * (v - (c = label + 1)::INT))) * (list_sum(list_transform(x, lambda v: v * v)) + 1)))')} AS grand FROM linp GROUP BY example_id"),
    "layered_logits": sql("netp", f"SELECT example_id, step, list_position(z, list_max(z)) - 1 = label AS acc, {r('ln(list_sum(ez)) + list_max(z) - z[label + 1]')} AS loss FROM netp"),
    "layered_activations": sql("net2", f"SELECT example_id, step, 3 AS layer_idx, 'fc0_relu.out' AS layer, i - 1 AS pos, {r('h0[i]')} AS act FROM (SELECT *, unnest(range(1, 17)) AS i FROM net2) UNION ALL SELECT example_id, step, 5 AS layer_idx, 'fc1.out' AS layer, i - 1 AS pos, {r('a1[i]')} AS act FROM (SELECT *, unnest(range(1, 13)) AS i FROM net2)"),
    "discovered_layers": sql("net3", "SELECT a.i AS layer_idx, a.layer, count(*) AS n FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.i < a.i AND b.i IN (SELECT c.i FROM m c JOIN m d ON c.example_id = d.example_id AND d.i = a.i GROUP BY c.i HAVING bool_and(c.act = d.act))) GROUP BY ALL",
        m="SELECT example_id, unnest([0, 1, 2, 3, 4, 5, 6, 7, 9]) AS i, unnest(['fc0.in', 'fc0.out', 'fc0_relu.in', 'fc0_relu.out', 'fc1.in', 'fc1.out', 'fc1_relu.in', 'fc1_relu.out', 'fc2.out']) AS layer, unnest([x, a0, a0, h0, h0, a1, a1, h1, z]) AS act FROM net3 WHERE step = 0"),
    "layered_input_gradient": sql("netp", f"SELECT example_id, step, i - 1 AS pos, {r('dx[i]', 9)} AS grad FROM (SELECT *, unnest(range(1, 65)) AS i FROM back)", back=BACK.format(error=CONFIDENCE_ERROR.format(y="label"))),
    "layered_grand": sql("netp", f"SELECT example_id, {r('avg(sqrt(' + ' + '.join((_PART('d0', 'x'), _PART('d1', 'h0'), _PART('d2', 'h1'))) + '))')} AS grand FROM back GROUP BY example_id", back=BACK.format(error=LOSS_ERROR.format(y="label"))),
    "layered_variance_of_gradients": sql("netp", VOG, back=BACK.format(error=LOSS_ERROR.format(y="(list_position(z, list_max(z)) - 1)")), grads="SELECT example_id, step, i - 1 AS j, dx[i] AS g FROM (SELECT *, unnest(range(1, 65)) AS i FROM back)"),
    "combine_metrics": sql("metrics", f"SELECT model, metric, example_id, {REDUCTIONS} FROM metrics GROUP BY ALL"),
    "is_train_sanity": sql("metrics", "SELECT model, metric, min(n)::BIGINT AS least, " + r("avg(n)") + " AS mean, max(n)::BIGINT AS most, 0::BIGINT AS violations FROM (SELECT model, metric, example_id, count(*) FILTER (WHERE is_train) AS n FROM metrics GROUP BY ALL) GROUP BY ALL"),
    "average_over_replicates": sql("metrics", f"SELECT model, example_id, {', '.join(f'''{r(f'avg(value) FILTER (WHERE metric = {chr(39)}{m}{chr(39)})')} AS {m}''' for m in METRIC_NAMES)} FROM metrics GROUP BY model, example_id"),
    "outer_union_models": sql("metrics", f"SELECT replicate, metric, example_id, {r('coalesce(a.value, b.value)')} AS value FROM (SELECT replicate, metric, example_id, value FROM metrics WHERE model = 'm0' AND is_train) a FULL JOIN (SELECT replicate, metric, example_id, value FROM metrics WHERE model = 'm1') b USING (replicate, metric, example_id)"),
    "metric_correlation_pearson": sql("metrics", f"SELECT model, metric_a, metric_b, {r('avg(corr)')} AS corr FROM pairs GROUP BY ALL", pairs=PAIRS.format(corr=CORR.format(a="av", b="bv"), v="value", t="metrics")),
    "metric_correlation_spearman": sql("metrics", f"SELECT model, metric_a, metric_b, {r('avg(corr)')} AS corr FROM pairs GROUP BY ALL", rounded="SELECT * REPLACE (round(value, 9) AS value) FROM metrics", ranked=RANKED.replace("FROM metrics", "FROM rounded"), pairs=PAIRS.format(corr=CORR.format(a="av", b="bv"), v="rnk", t="ranked")),
    "correlation_shrink": sql("metrics", f"SELECT model, metric_a, metric_b, {r('corr_of_avg')} AS corr_of_avg, {r('corr')} AS corr, {r('corr_of_avg - corr')} AS shrink FROM (SELECT model, metric_a, metric_b, avg(corr) AS corr FROM pairs GROUP BY ALL) JOIN (SELECT a.model, a.metric AS metric_a, b.metric AS metric_b, {CORR.format(a='a.value', b='b.value')} AS corr_of_avg FROM means a JOIN means b ON a.model = b.model AND a.example_id = b.example_id GROUP BY ALL) USING (model, metric_a, metric_b)", means="SELECT model, metric, example_id, avg(value) AS value FROM metrics GROUP BY ALL", pairs=PAIRS.format(corr=CORR.format(a="av", b="bv"), v="value", t="metrics")),
    "permutation_test": permuted("metrics", "metrics", "model_a, model_b, metric", "sqrt(sum(diff * diff))"),
    "permutation_test_per_example": permuted("metrics", "metrics", "model_a, model_b, metric, example_id", "any_value(abs(diff))", nlogp=True),
    "permutation_test_median": permuted("metrics", "metrics", "model_a, model_b, metric", "max(abs(diff))", f="median"),
    "permutation_test_ranks": permuted("three", "ranked", "model_a, model_b, metric", "sqrt(sum(diff * diff))", value="rnk", ranked=RANKED.replace("FROM metrics", "FROM three")),
    "permutation_summary": permuted("three", "scaled", "model_a, model_b", "sqrt(sum(diff * diff))", scaled=SCALED),
    "permutation_per_example_all_metrics": permuted("three", "scaled", "model_a, model_b, example_id", "sqrt(sum(diff * diff))", nlogp=True, scaled=SCALED),
    "standardize": sql("metrics", f"SELECT model, replicate, metric, example_id, {r('CASE WHEN sd > 0 THEN (value - mean) / sd ELSE value - mean END')} AS scaled FROM (SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd FROM metrics WINDOW w AS (PARTITION BY model, replicate, metric))"),
    "split_batches": "SELECT label, vec_id AS example_id, ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 15)::BIGINT AS batch FROM embeddings",
    "batch_accumulator": f"SELECT user_id, count(*) AS n, {r('avg(value)')} AS mean FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 GROUP BY user_id",
    "correlation_heatmap": sql("metrics", f"SELECT a.model, a.metric AS metric_a, b.metric AS metric_b, CASE WHEN any_value(a.metric = b.metric) THEN 0 ELSE {r(CORR.format(a='a.value', b='b.value'))} END AS corr_of_avg FROM means a JOIN means b ON a.model = b.model AND a.example_id = b.example_id GROUP BY a.model, a.metric, b.metric", means="SELECT model, metric, example_id, avg(value) AS value FROM metrics GROUP BY ALL"),
    "apply_to_metrics": sql("point", f"SELECT example_id, step, {', '.join(f'{r(f'{m} * 100', 3)} AS pct_{m}' for m in METRIC_NAMES[1:])} FROM point"),
    "known_models": sql("metrics", "SELECT model, metric, count(*) AS n, 'second' AS name, 0 AS place FROM metrics WHERE model = 'm1' GROUP BY ALL"),
    "one_checkpoint": sql("metrics", f"SELECT example_id, {r('value')} AS value FROM metrics WHERE model = 'm1' AND replicate = 2 AND metric = 'ent'"),
    "correlation_of_medians": sql("metrics", f"SELECT a.model, a.metric AS metric_a, b.metric AS metric_b, {r(CORR.format(a='a.value', b='b.value'))} AS corr_of_avg FROM means a JOIN means b ON a.model = b.model AND a.example_id = b.example_id GROUP BY a.model, a.metric, b.metric", means="SELECT model, metric, example_id, median(value) AS value FROM metrics GROUP BY ALL"),
    "representation_metrics_options": sql("soft point acts", f"SELECT coalesce(p.example_id, d.example_id) AS example_id, p.label, {r('p.proto')} AS proto, d.pd, d.m0 AS pdlayer0, d.m2 AS pdlayer2, d.m3 AS pdlayer3, d.m4 AS pdlayer4, s.acc, {', '.join(f'{r(f's.{m}')} AS {m}' for m in METRIC_NAMES[1:])} FROM (SELECT * FROM protos WHERE layer_idx = 1) p FULL JOIN (SELECT example_id, coalesce(max(layer_idx) FILTER (WHERE NOT match) + 1, 0)::BIGINT AS pd, {', '.join(f'bool_or(match) FILTER (WHERE layer_idx = {i}) AS m{i}' for i in (0, 2, 3, 4))} FROM voted GROUP BY example_id) d ON p.example_id = d.example_id LEFT JOIN (SELECT * FROM point WHERE step = 5 AND example_id % 5 <> 0) s ON s.example_id = coalesce(p.example_id, d.example_id)",
        every="SELECT * FROM acts WHERE layer_idx <> 1 UNION ALL SELECT 4 AS layer_idx, example_id, label, list_transform(p, lambda v: round(v, 9)) AS act FROM soft WHERE step = 5", tr="SELECT * FROM every WHERE example_id % 5 <> 0", te="SELECT * FROM every WHERE example_id % 5 = 0",
        near=KNN.format(q="te", t="tr", k=15), voted=VOTED.format(q="te"), protos=PROTO.replace("FROM acts", "FROM (SELECT * FROM acts WHERE example_id % 5 <> 0)")),
    "nearest_center": sql("acts", f"SELECT a.example_id, {r('min(list_distance(a.act, c.center))')} AS nearest FROM acts a, (SELECT label, list(m ORDER BY pos) AS center FROM (SELECT label, pos, avg(v) AS m FROM (SELECT label, unnest(range(16)) AS pos, unnest(act) AS v FROM acts WHERE layer_idx = 3) GROUP BY ALL) GROUP BY ALL) c WHERE a.layer_idx = 3 GROUP BY a.example_id"),
    "input_gradient_by_step": sql("linp", f"SELECT example_id, step, j AS pos, {r('g')} AS grad FROM grads", grads=LOSS_GRAD),
    "metric_folders": sql("metrics", f"SELECT model, replicate, metric, example_id, {r('value')} AS value, is_train FROM metrics WHERE model = 'm1' AND metric IN ('ent', 'margin')"),
    "metric_files": sql("metrics", "SELECT DISTINCT model, replicate::VARCHAR AS replicate, metric FROM metrics"),
    "checkpoints_listed": sql("dense", "SELECT DISTINCT step::BIGINT AS step FROM dense"),
    "exported_csv": sql("metrics", f"SELECT example_id, {', '.join(f'{r(f'avg(value) FILTER (WHERE metric = {chr(39)}{m}{chr(39)})')} AS all_mean_{m}, {r(f'median(value) FILTER (WHERE is_train AND metric = {chr(39)}{m}{chr(39)})')} AS train_median_{m}' for m in METRIC_NAMES)} FROM metrics GROUP BY example_id"),
    "runs_of_a_model": sql("metrics", "SELECT model || '_' || replicate AS run, count(*) AS n FROM metrics WHERE model = 'm1' AND replicate <> 2 GROUP BY ALL"),
    "saved_state": sql("metrics", f"SELECT metric, example_id, count(*)::BIGINT AS n, {r('avg(value)')} AS mean, {r('var_samp(value)')} AS variance FROM metrics GROUP BY metric, example_id"),
    "array_files": f"SELECT vec_id, pos::BIGINT AS pos, {r('v::DOUBLE')} AS value FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings)",
    "published_orders": sql("metrics", f"SELECT k.metric, row_number() OVER (PARTITION BY k.metric ORDER BY round(value, 9), example_id) - 1 AS rank, example_id FROM metrics m JOIN (VALUES ('adv', 'ent'), ('agr', 'conf'), ('conf', 'maxconf'), ('priv', 'margin'), ('ret', 'el2n')) k(metric, score) ON m.metric = k.score WHERE model = 'm0' AND replicate = 0"),
    "published_influence": f"SELECT vec_id AS pos, vec_id AS tr_idx, vec_id * 7 % 10 AS tt_idx, {r('embedding[1]::DOUBLE')} AS infl, {r('embedding[2]::DOUBLE')} AS mem FROM embeddings WHERE vec_id >= 10",
    "published_scores": f"SELECT vec_id AS example_id, {r('embedding[3]::DOUBLE')} AS memorization, {r('embedding[4]::DOUBLE')} AS distance FROM embeddings",
    "stacked_steps": sql("dense", "SELECT example_id, acc, step FROM dense"), "appended_steps": sql("dense", "SELECT example_id, step, acc FROM dense"),
    "first_rows_appended": f"SELECT event_id, {r('value')} AS value FROM events QUALIFY row_number() OVER (ORDER BY event_id) <= (SELECT count(*) * 3 // 4 FROM events)",
    "representation_metrics_clusters": sql("acts", f"SELECT p.example_id, p.label, {r('p.proto')} AS proto, {r('list_distance(a.act, c.center)')} AS selfproto, d.pd FROM protos p JOIN (SELECT example_id, coalesce(max(layer_idx) FILTER (WHERE NOT match) + 1, 0)::BIGINT AS pd FROM voted GROUP BY example_id) d USING (example_id) JOIN moved a ON a.example_id = p.example_id AND a.layer_idx = 3 JOIN (SELECT side, list(m ORDER BY pos) AS center FROM (SELECT label % 2 AS side, pos, avg(v) AS m FROM (SELECT label, unnest(range(16)) AS pos, unnest(act) AS v FROM moved WHERE layer_idx = 3) GROUP BY ALL) GROUP BY side) c ON c.side = a.label % 2 WHERE p.layer_idx = 3",
        moved="SELECT layer_idx, example_id, label, list_transform(act, lambda v: v + CASE WHEN layer_idx = 3 THEN label % 2 * 100.0::DOUBLE ELSE 0 END) AS act FROM acts", protos=PROTO.replace("FROM acts", "FROM moved"), near=KNN.format(q="moved", t="moved", k=30), voted=VOTED.format(q="moved")),
    "sql_scores": sql("point", f"SELECT example_id, label, step, acc, {', '.join(f'{r(m)} AS {m}' for m in (*METRIC_NAMES[1:], 'loss'))} FROM point"),
    "sql_events": edges("ragged", False, countforget=COUNT, unforgettable=UNFORGETTABLE, firstlearn=FIRSTLEARN),
    "table_function_batches": "SELECT label, vec_id AS example_id, ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 15)::BIGINT AS batch FROM embeddings",
    "table_function_events": sql("ragged", "SELECT example_id, step, acc, NOT before AND acc AS learned, before AND NOT acc AS forgot FROM marked", marked=MARKED.format(start="false", source="ragged")),
    "bucketed_labels": sql("point", f"SELECT example_id, label, step, acc, {', '.join(f'{r(m)} AS {m}' for m in METRIC_NAMES[1:])} FROM point"),
    "observed_range": sql("metrics", f"SELECT model, replicate, metric, example_id, {r('(value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ())')} AS share, {r('avg(is_train::INT) OVER ()')} AS train_share FROM metrics"),
    "replicates_of_a_metric": sql("metrics", f"SELECT replicate, example_id, {r('value')} AS value FROM metrics WHERE model = 'm0' AND metric = 'conf'"),
    "metric_names": sql("metrics", "SELECT DISTINCT metric FROM metrics"),
    "key_checks": sql("metrics", "SELECT a.model, a.metric, a.replicate AS run_a, b.replicate AS run_b, any_value(n) AS n_both, any_value(n) = any_value(a.size) AND any_value(n) = any_value(b.size) AS same, any_value(n) = 0 AS disjoint FROM sizes a JOIN sizes b ON a.model = b.model AND a.metric = b.metric AND a.replicate < b.replicate, LATERAL (SELECT count(*) AS n FROM train x JOIN train y ON x.example_id = y.example_id AND x.model = y.model AND x.metric = y.metric WHERE x.model = a.model AND x.metric = a.metric AND x.replicate = a.replicate AND y.replicate = b.replicate) GROUP BY ALL",
        train="SELECT * FROM metrics WHERE is_train", sizes="SELECT model, metric, replicate, count(*) AS size FROM train GROUP BY ALL"),
    "renamed_columns": sql("dense", "SELECT example_id, step, acc::INT AS np_acc FROM dense"),
    "layers_named": "SELECT 'block' || i AS module, count(*) AS n FROM embeddings, (SELECT unnest([1, 2]) AS i) GROUP BY ALL",
    "stream_event_times": sql("ragged", f"SELECT example_id, count(*) AS n, {FIRSTLEARN} AS firstlearn, {FIRSTUNFORGETTABLE} AS firstunforgettable, {FIRSTFORGET} AS firstforget, {FIRSTUNLEARNABLE} AS firstunlearnable FROM ragged GROUP BY example_id"),
    "stream_forget_metrics_late": edges("ragged", False, n="count(*)", countforget=COUNT, unforgettable=UNFORGETTABLE, firstlearn=FIRSTLEARN, firstunforgettable=FIRSTUNFORGETTABLE),
    "stream_from_saved_state": edges("ragged", False, n="count(*)", countforget=COUNT, unforgettable=UNFORGETTABLE, firstlearn=FIRSTLEARN, firstunforgettable=FIRSTUNFORGETTABLE),
    "trajectory_segments": segments("step % 3 <> 0"), "stream_segments_state": segments("(step * 7 + example_id) % 3 < 2"),
    "stream_online_pointwise": sql("point", f"SELECT example_id, count(*) AS n, {STEPPED('avg', 'avg')}, {STEPPED('var_samp', 'var')} FROM point GROUP BY example_id"),
    "stream_ensemble_metrics": sql("point", f"SELECT p.example_id, count(*) AS n, CASE WHEN bool_and(acc) THEN 1 WHEN NOT bool_or(acc) THEN -1 ELSE 0 END AS ddd, {r('avg(acc::INT)')} AS allacc, any_value(c.pred)::INT AS consensuslabel FROM point p JOIN (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY n DESC, pred) AS rn FROM (SELECT example_id, pred, count(*) AS n FROM point GROUP BY ALL)) c ON p.example_id = c.example_id AND rn = 1 GROUP BY p.example_id"),
    "stream_variance_of_gradients": sql("linp", VOG, grads=CLASS_GRAD.format(y="label")),
    "stream_forget_metrics": edges("ragged", False, n="count(*)", countforget=COUNT, unforgettable=UNFORGETTABLE, firstlearn=FIRSTLEARN, firstunforgettable=FIRSTUNFORGETTABLE),
}
