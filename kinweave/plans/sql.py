"""Common table expressions of the DuckDB forms of the queries."""

from __future__ import annotations

from kinweave.spec import MISSING

TOKENS = "(" + ", ".join(f"'{t}'" for t in MISSING) + ")"
SEED, BUDGET = 42, 2


def valid(x: str) -> str:
    return f"CASE WHEN trim(({x})::VARCHAR) NOT IN {TOKENS} THEN ({x})::VARCHAR END"


ENTITIES = f"""e0 AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS ts, (event_type = 'error')::INT AS label, event_type AS category, value, user_id,
  json_extract_string(props, '$.k') AS prop, {valid("user_id")} AS via_user, {valid("json_extract_string(props, '$.k')")} AS via_prop,
  {valid("floor(epoch_us(ts) / 1e6 / 300)::BIGINT")} AS via_timebin FROM events)"""


def cut(train: str, val: str) -> str:
    return f"CASE WHEN pos < {train} THEN 'train' WHEN pos < {train} + {val} THEN 'val' ELSE 'test' END"


def class_split(source: str = "e0", test: str = "0.2") -> str:
    return f"""(SELECT * EXCLUDE (n, pos, n_test, n_val), CASE WHEN n < 3 THEN 'train' ELSE {cut("n - n_test - n_val", "n_val")} END AS split FROM
  (SELECT *, greatest(1, round_even(n * {test}, 0)::BIGINT) AS n_test, greatest(1, round_even(n * 0.1, 0)::BIGINT) AS n_val FROM
  (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY ts, id) - 1 AS pos FROM {source})))"""


ENT = f"{ENTITIES}, ent AS MATERIALIZED {class_split()}"
RELATIONS = ("via_user", "via_prop", "via_timebin")


def long(relations=RELATIONS, source: str = "ent", where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT '{r}' AS relation, {r} AS value, id, split FROM {source} WHERE {r} IS NOT NULL AND {where}" for r in relations)


def ring(name: str, values: str, degree: int = BUDGET, seed=SEED, keys: str = "relation") -> str:
    """CTEs that end in ``name``, the edges over the values of a query."""
    return f"""{name}_p AS MATERIALIZED (SELECT {keys}, value, id, count(*) OVER g AS n, row_number() OVER (PARTITION BY {keys}, value ORDER BY md5(concat_ws('|', '{seed}', value, id)), id) - 1 AS pos
  FROM ({values}) WINDOW g AS (PARTITION BY {keys}, value)),
  {name}_f AS MATERIALIZED (SELECT a.relation, a.id AS src, b.id AS dst FROM (SELECT *, unnest(CASE WHEN n - 1 <= {degree} THEN range(1, n - pos) ELSE range(1, {degree // 2 + 1}) END) AS o FROM {name}_p WHERE n > 1) a
    JOIN {name}_p b ON a.relation = b.relation AND a.value = b.value AND b.pos = (a.pos + a.o) % a.n),
  {name} AS MATERIALIZED (SELECT relation, src, dst FROM {name}_f UNION ALL SELECT relation, dst, src FROM {name}_f)"""


EDGES = f"{ENT}, {ring('edges', long())}"
TRAIN = ring("train_edges", long(where="split = 'train'"))


def draw(j: int, n: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{SEED}:{j}', value, id)), 1, 8))::BIGINT % ({n}))"


ATTACH = f"""tp AS MATERIALIZED (SELECT relation, value, id, count(*) OVER (PARTITION BY relation, value) AS n, row_number() OVER (PARTITION BY relation, value ORDER BY md5(concat_ws('|', '{SEED}', value, id)), id) - 1 AS pos
  FROM ({long(where="split = 'train'")})),
  drawn AS (SELECT relation, value, id, n, {draw(0, "n")} AS r0, CASE WHEN n > 1 THEN {draw(1, "greatest(n - 1, 1)")} END AS r1 FROM ({long(where="split <> 'train'")}) JOIN (SELECT DISTINCT relation, value, n FROM tp) USING (relation, value)),
  chosen AS (SELECT relation, value, id AS dst, unnest(CASE WHEN n <= 2 THEN range(0, n) ELSE [r0, r1 + (r1 >= r0)::INT] END) AS pos FROM drawn),
  attached AS MATERIALIZED (SELECT c.relation, tp.id AS src, c.dst FROM chosen c JOIN tp ON c.relation = tp.relation AND c.value = tp.value AND c.pos = tp.pos)"""

ENDS = "SELECT e.*, s.label AS sl, s.split AS ss, d.label AS dl, d.split AS ds FROM {edges} e JOIN ent s ON e.src = s.id JOIN ent d ON e.dst = d.id"
FIELDS = ("user_id", "prop")


def fields(source: str = "ent", names=FIELDS) -> str:
    return " UNION ALL ".join(f"SELECT id, label, split, '{f}' AS field, {valid(f)} AS value FROM {source}" for f in names)
