"""Registered queries of identity administration, on accounts whose values are made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import administration as admin
from .operators import identity
from .operators.identity import EXCLUDED
from .queries import query
from .runtime import table

_KINDS = ("email", "username", "display_name", "first_name", "last_name", "id", "parent_email")
_I = f"""i AS (SELECT ['git-hub', 'hr_system', 'chat'][o_custkey % 3 + 1] AS source_type, 's' AS source_id, CAST(o_custkey % 700 AS VARCHAR) AS account_id, [{', '.join(f"'{k}'" for k in _KINDS)}][o_orderkey % 7 + 1] AS value_type,
  CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 7 IN (0, 6) THEN 'P' || (o_custkey % 40) || '@x' ELSE 'V' || (o_orderkey % 1000) END AS value, o_orderkey % 13 = 0 AS gone, o_orderkey AS v FROM orders),
f AS (SELECT source_type, source_id, account_id, arg_max(gone, v) AS is_closed, {', '.join(f"arg_max(value, v) FILTER (value_type = '{k}' AND NOT gone AND value <> '') AS {n}" for k, n in zip(_KINDS, (*_KINDS[:5], 'binding_id', 'manager_email'), strict=True))} FROM i GROUP BY 1, 2, 3),
b AS (SELECT source_type, source_id, account_id, CASE WHEN n % 30 = 1 THEN '{EXCLUDED}' ELSE 'B' || (n % 37) END AS person_id, ['operator', 'automatic', 'unconfirmed', 'roster'][n % 4 + 1] AS provenance
  FROM (SELECT DISTINCT source_type, source_id, account_id, CAST(account_id AS BIGINT) AS n FROM i) WHERE n % 5 <> 0)"""
_A = f"""{_I},
h AS (SELECT lower(email) AS address, count(DISTINCT person_id) AS n, bool_or(provenance = 'operator') AS settled FROM f JOIN b USING (source_type, source_id, account_id) WHERE NOT is_closed AND email IS NOT NULL AND person_id <> '{EXCLUDED}' GROUP BY 1),
a AS (SELECT f.*, person_id, provenance, coalesce(h.n, 0) AS n_candidates, settled, CASE WHEN person_id = '{EXCLUDED}' THEN 'excluded' WHEN person_id IS NOT NULL THEN 'bound' WHEN email IS NULL THEN 'no_evidence' WHEN coalesce(h.n, 0) > 1 THEN 'contested'
  WHEN binding_id IS NULL AND coalesce(h.n, 0) = 0 AND NOT (lower(email) IN (SELECT 'p' || k || '@x' FROM range(10) r(k))) THEN 'no_source_id' ELSE 'pending' END AS state
  FROM f LEFT JOIN b USING (source_type, source_id, account_id) LEFT JOIN h ON h.address = lower(email) WHERE NOT is_closed)"""


def _folded(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    value = F.when(k % 11 == 0, "").when((k % 7).isin(0, 6), F.concat(F.lit("P"), c % 40, F.lit("@x"))).otherwise(F.concat(F.lit("V"), k % 1000))
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), n.cast("int") + 1)
    inputs = table(spark, d, "orders").select(
        pick(("git-hub", "hr_system", "chat"), c % 3).alias("source_type"), F.lit("s").alias("source_id"), (c % 700).cast("string").alias("account_id"), pick(_KINDS, k % 7).alias("value_type"), value.alias("value"),
        (k % 13 == 0).alias("is_delete"), F.floor(k / 8).alias("synced_at"), k.alias("version"),
    )
    folded = admin.fold_evidence(inputs)
    n = F.col("account_id").cast("long")
    person = F.when(n % 30 == 1, EXCLUDED).otherwise(F.concat(F.lit("B"), n % 37))
    bindings = folded.where(n % 5 != 0).select(*admin.ACCOUNT, person.alias("person_id"), pick(("operator", "automatic", "unconfirmed", "roster"), n % 4).alias("provenance"))
    return folded, bindings


@query(f"WITH {_I} SELECT source_type, account_id, is_closed, email, username, display_name, first_name, last_name, manager_email, binding_id FROM f")
def account_evidence(spark, d):
    return _folded(spark, d)[0].select("source_type", "account_id", "is_closed", "email", "username", "display_name", "first_name", "last_name", "manager_email", "binding_id")


@query(f"""WITH {_I}, l AS (SELECT *, lower(coalesce(email, username, display_name, nullif(trim(concat_ws(' ', first_name, last_name)), ''), account_id)) AS label FROM f WHERE NOT is_closed)
SELECT label, source_type, account_id FROM l WHERE (contains(lower(coalesce(email, '')), 'hub') OR contains(lower(coalesce(username, '')), 'hub') OR contains(lower(account_id), 'hub') OR contains(lower(coalesce(display_name, '')), 'hub') OR contains(lower(concat_ws(' ', first_name, last_name)), 'hub') OR contains(lower('_' || replace(source_type, '-', '_')), '_hub'))
  AND (label, source_type, source_id, account_id) > ('p1@x', 'git-hub', 's', '100') ORDER BY label, source_type, source_id, account_id LIMIT 21""")
def account_listing(spark, d):
    """A page of the accounts of a source, from a key on."""
    out = admin.list_accounts(_folded(spark, d)[0], "HUB", ("p1@x", "git-hub", "s", "100"))
    return out.select("label", "source_type", "account_id")


def _review(spark, d):
    owners = spark.range(10).select(F.concat(F.lit("P"), "id", F.lit("@x")).alias("email"), F.concat(F.lit("E"), "id").alias("person_id"))
    return admin.review(*_folded(spark, d), owners)


@query(f"""WITH {_A} SELECT kind, source_type, account_id, email, CASE WHEN state <> 'excluded' THEN person_id END AS person_id, n_candidates FROM (
  SELECT *, CASE WHEN state IN ('no_evidence', 'contested', 'no_source_id') THEN state WHEN state = 'bound' AND provenance = 'unconfirmed' THEN 'provisioned_at_login' WHEN state = 'bound' AND provenance = 'roster' THEN 'minted_from_roster' END AS kind FROM a
  UNION ALL SELECT *, 'binding_conflict' FROM a WHERE n_candidates > 1 AND NOT settled) WHERE kind IS NOT NULL""")
def review_items(spark, d):
    return _review(spark, d)[0].select("kind", "source_type", "account_id", "email", "person_id", "n_candidates")


@query(f"WITH {_A} SELECT count(*) AS observed, {', '.join(f'count(*) FILTER (state = {s!r}) AS {s}' for s in ('bound', 'excluded', 'no_evidence', 'no_source_id'))}, count(*) FILTER (state IN ('pending', 'contested')) AS pending FROM a")
def review_rates(spark, d):
    return _review(spark, d)[1]


_AT = "2030-01-01 00:00:00"


@query(f"""WITH {_I}, w AS (SELECT source_type, source_id, account_id, 'B' || (CAST(account_id AS BIGINT) % 36) AS person_id FROM f),
t AS (SELECT person_id, source_type, max(1000000 * (1893456000 - 500 + CAST(account_id AS BIGINT))) AS last FROM b GROUP BY 1, 2),
x AS (SELECT w.*, CASE WHEN b.person_id = w.person_id AND provenance = 'operator' THEN 'already_decided' ELSE 'applied' END AS outcome FROM w LEFT JOIN b USING (source_type, source_id, account_id))
SELECT source_type, account_id, x.person_id, outcome, CASE WHEN outcome = 'applied' THEN CAST(greatest(1893456000000000, coalesce(last + 1, 0)) + row_number() OVER (PARTITION BY x.person_id, source_type, outcome ORDER BY account_id) - 1 AS VARCHAR) END AS created_at
FROM x LEFT JOIN t USING (person_id, source_type)""", stamps="")
def operator_decisions(spark, d):
    """Each account given to a person; the journal has rows of the bindings around the time of the decision."""
    folded, bindings = _folded(spark, d)
    journal = bindings.select("person_id", "source_type", "source_id", F.lit("id").alias("value_type"), F.timestamp_seconds(F.lit(1893456000 - 500) + F.col("account_id").cast("long")).alias("created_at"))
    wanted = folded.select(*admin.ACCOUNT, F.concat(F.lit("B"), F.col("account_id").cast("long") % 36).alias("person_id"))
    out = admin.decide(wanted, bindings, journal, F.lit(_AT).cast("timestamp"))
    return out.select("source_type", "account_id", "person_id", "outcome", F.unix_micros("created_at").cast("string").alias("created_at"))


_O = f"""o AS (SELECT 'P' || (o_custkey % 90) AS person_id, ['git-hub', 'hr_system', 'chat'][o_custkey % 3 + 1] AS source_type, 's' AS source_id, [{', '.join(f"'{k}'" for k in _KINDS)}][o_orderkey % 7 + 1] AS value_type,
  CASE WHEN o_orderkey % 7 = 5 THEN CASE WHEN o_orderkey % 4 > 0 THEN 'A' || (o_custkey % 60) END WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'V' || (o_orderkey % 1000) END AS value, o_orderkey // 8 AS created_at, o_orderkey AS id FROM orders)"""


def _observations(spark, d):
    """An observation for each order: every third is blank, up to eight have one instant."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), n.cast("int") + 1)
    account = F.when(k % 4 > 0, F.concat(F.lit("A"), c % 60))
    value = F.when(k % 7 == 5, account).when(k % 3 == 0, " ").otherwise(F.concat(F.lit("V"), k % 1000))
    return table(spark, d, "orders").select(
        F.concat(F.lit("P"), c % 90).alias("person_id"), pick(("git-hub", "hr_system", "chat"), c % 3).alias("source_type"), F.lit("s").alias("source_id"),
        pick(_KINDS, k % 7).alias("value_type"), value.alias("value"), F.floor(k / 8).alias("created_at"), k.alias("id"),
    )


@query(f"""WITH {_O}, r AS (SELECT *, row_number() OVER (PARTITION BY source_type, source_id, value, created_at ORDER BY id DESC) AS n FROM o WHERE value_type = 'id' AND value IS NOT NULL)
SELECT source_type, source_id, value AS account_id, person_id, created_at AS valid_from, lead(created_at) OVER (PARTITION BY source_type, source_id, value ORDER BY created_at) AS valid_to FROM r WHERE n = 1""")
def account_persons(spark, d):
    return identity.account_persons(_observations(spark, d))


@query(f"""WITH {_O}, c AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY person_id, source_type, source_id, value_type ORDER BY created_at DESC, id DESC) = 1),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY person_id, value_type ORDER BY created_at DESC, id DESC) = 1),
p AS (SELECT person_id, {', '.join(f"nullif(trim(max(value) FILTER (value_type = '{k}')), '') AS {k}" for k in _KINDS[:5])} FROM l WHERE value_type IN ({', '.join(f"'{k}'" for k in _KINDS[:5])}) GROUP BY 1)
SELECT person_id, coalesce(display_name, nullif(concat_ws(' ', first_name, last_name), ''), username, email) AS label FROM p""")
def latest_labels(spark, d):
    return identity.labels(_observations(spark, d))
