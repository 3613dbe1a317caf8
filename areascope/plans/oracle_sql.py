"""Independent DuckDB SQL for the registered queries.

Written the straightforward way (clean each feed, roll it up, two full outer
joins), so it cross-checks the Spark plans, which take other routes (one
shuffle for the master, broadcast district statistics, ...). The raw-feed
derivation mirrors ``sources.testdata``.
"""

from __future__ import annotations

from .. import constants as K

_ALIAS_CASE = "CASE {x} " + " ".join(
    f"WHEN '{a}' THEN '{b}'" for a, b in K.STATE_ALIASES.items()) + " ELSE {x} END"


# White space as Unicode has it.
BLANK = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def _squash(x: str) -> str:
    return f"regexp_replace({strip(f'lower({x})')}, '{BLANK}+', ' ', 'g')"


def _state(x: str) -> str:
    s = f"replace(replace({_squash(x)}, ' & ', ' and '), '&', 'and')"
    return _ALIAS_CASE.format(x=s)


def _district(x: str) -> str:
    return f"replace({_squash(x)}, '*', '')"


def _count(x: str) -> str:
    return f"CAST(trunc(COALESCE(TRY_CAST({x} AS DOUBLE), 0)) AS BIGINT)"


def _keys(ts: str) -> str:
    return f"""
      CASE WHEN v = 9 THEN '31-02-' || CAST(year({ts}) AS VARCHAR) ELSE strftime({ts}, '%d-%m-%Y') END AS date,
      CASE WHEN v = 0 THEN lower(nation) WHEN v = 1 THEN edge || edge || nation || edge
           WHEN v = 2 THEN replace(nation, ' ', '  ')
           WHEN v = 3 THEN CASE u WHEN 0 THEN 'Orissa' WHEN 1 THEN 'Pondicherry' WHEN 2 THEN 'Nagpur City' ELSE 'Unknown Place' END
           WHEN v = 4 THEN NULL ELSE nation END AS state,
      CASE WHEN v = 5 THEN c_mktsegment || '  *' WHEN v = 6 THEN lower(c_mktsegment)
           WHEN v = 7 THEN NULL ELSE c_mktsegment END AS district,
      CASE WHEN v = 8 THEN '12345' ELSE CAST(100000 + o_custkey % 900000 AS VARCHAR) END AS pincode"""


_Q = "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)"

RAW_CTES = f"""
cust AS (
  SELECT c_custkey, c_mktsegment, replace(n_name, '_', ' ') AS nation
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
valid_names AS (SELECT lower(replace(n_name, '_', ' ')) AS state FROM nation),
bio_raw AS (
  SELECT {_keys('o_orderdate')},
    CASE WHEN v = 10 THEN 'x' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '1' ELSE '0' END AS bio_age_5_17,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '0' ELSE '1' END AS bio_age_17_
  FROM (SELECT *, o_orderkey % 20 AS v, o_orderkey // 20 % 5 AS u, CASE u WHEN 0 THEN chr(160) WHEN 1 THEN chr(9) ELSE ' ' END AS edge
        FROM orders JOIN cust ON o_custkey = c_custkey)),
lines AS (
  SELECT *, (l_orderkey + l_linenumber) % 20 AS v, (l_orderkey + l_linenumber) // 20 % 5 AS u,
    CASE u WHEN 0 THEN chr(160) WHEN 1 THEN chr(9) ELSE ' ' END AS edge
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey),
demo_raw AS (
  SELECT {_keys('l_shipdate')},
    CASE WHEN v = 10 THEN {_Q} || '.7' WHEN l_linestatus = 'F' THEN {_Q} ELSE '0' END AS demo_age_5_17,
    CASE WHEN l_linestatus = 'O' THEN {_Q} ELSE '0' END AS demo_age_17_
  FROM lines),
enrol_raw AS (
  SELECT {_keys('o_orderdate')},
    CASE WHEN v = 10 THEN 'x' WHEN l_returnflag = 'A' THEN {_Q} ELSE '0' END AS age_0_5,
    CASE WHEN l_returnflag = 'N' THEN {_Q} ELSE '0' END AS age_5_17,
    CASE WHEN l_returnflag = 'R' THEN {_Q} ELSE '0' END AS age_18_greater
  FROM lines)"""


def _std(feed: str, raw_to_out: dict) -> str:
    ms = ",\n      ".join(f"{_count(r)} AS {o}" for r, o in raw_to_out.items())
    return f"""
std_{feed} AS (
  SELECT * FROM (
    SELECT CAST(try_strptime(date, '%d-%m-%Y') AS DATE) AS d,
      {_state('state')} AS state,
      {_district('district')} AS district,
      TRY_CAST(pincode AS INTEGER) AS pincode,
      {ms}
    FROM {feed}_raw)
  WHERE d IS NOT NULL AND state IN (SELECT state FROM valid_names)
    AND pincode BETWEEN 100000 AND 999999)"""


def _monthly(feed: str, outs: list, suffix: str) -> str:
    caps = ", ".join(f"quantile_cont({o}, 0.99) AS cap_{o}" for o in outs)
    sums = ",\n    ".join(f"sum(least(CAST({o} AS DOUBLE), cap_{o})) AS {o}{suffix}" for o in outs)
    tot = " + ".join(f"{o}{suffix}" for o in outs)
    comp = " + ".join(f"CAST({o}{suffix} > 0 AS INTEGER)" for o in outs)
    return f"""
cap_{feed} AS (SELECT {caps} FROM std_{feed}),
mon_{feed} AS (
  SELECT strftime(d, '%Y-%m') AS year_month, state, district, pincode,
    {sums}
  FROM std_{feed}, cap_{feed}
  WHERE district IS NOT NULL
  GROUP BY ALL),
q_{feed} AS (
  SELECT *, {tot} AS total_activity{suffix},
    ({comp}) / {float(len(outs))} AS data_completeness{suffix},
    ({comp}) / {float(len(outs))} * 100 AS data_quality_score{suffix}
  FROM mon_{feed})"""


_BIO = {"bio_age_5_17": "updates_age_5_17", "bio_age_17_": "updates_age_18_plus"}
_DEMO = {"demo_age_5_17": "updates_age_5_17", "demo_age_17_": "updates_age_18_plus"}
_ENROL = {"age_0_5": "enrollments_age_0_5", "age_5_17": "enrollments_age_5_17",
          "age_18_greater": "enrollments_age_18_plus"}

_FILL = [c for c in (
    "updates_age_5_17_bio updates_age_18_plus_bio data_quality_score_bio "
    "updates_age_5_17_demo updates_age_18_plus_demo data_quality_score_demo "
    "enrollments_age_0_5 enrollments_age_5_17 enrollments_age_18_plus data_quality_score").split()]
_KEEP = ["total_activity_bio", "data_completeness_bio", "total_activity_demo",
         "data_completeness_demo", "total_activity", "data_completeness"]

MASTER_CTES = RAW_CTES + "," + ",".join([
    _std("bio", _BIO), _std("demo", _DEMO), _std("enrol", _ENROL),
    _monthly("bio", list(_BIO.values()), "_bio"),
    _monthly("demo", list(_DEMO.values()), "_demo"),
    _monthly("enrol", list(_ENROL.values()), ""),
]) + """,
master AS (
  SELECT year_month, state, district, pincode,
    """ + ", ".join(f"COALESCE({c}, 0) AS {c}" for c in _FILL) + ", " + ", ".join(_KEEP) + """
  FROM q_bio FULL JOIN q_demo USING (year_month, state, district, pincode)
             FULL JOIN q_enrol USING (year_month, state, district, pincode))"""


def with_master(select: str) -> str:
    return f"WITH {MASTER_CTES}\n{select}"
