"""What operators of identities work with: accounts as their evidence tells, the queue of open cases with its rates, and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .identity import ACCOUNT, EXCLUDED, ID_LENGTH, normal_email

#: Values that an account is described by; most accounts that one call decides, rows of a page, and names of outcomes.
VALUES = ("email", "username", "display_name", "first_name", "last_name", "job_title", "department", "status")
MOST_DECIDED, PAGE = 1_000, 20
APPLIED, ALREADY, OPERATOR = "applied", "already_decided", "operator"


def fold_evidence(inputs: DataFrame) -> DataFrame:
    """An account each, with its last value of every kind, manager_email, binding_id, and is_closed: whether its last input took something back.

    inputs: source_type, source_id, account_id, value_type, value, is_delete, synced_at, version. Empty values and what was
    taken back don't count. Of equal times the higher version is the later one.
    """
    order = F.struct("synced_at", "version")
    stated = ~F.col("is_delete") & (F.col("value") != "")

    def last(kind: str, more: Column | None = None) -> Column:
        mine = stated & (F.col("value_type") == kind) & (F.lit(True) if more is None else more)
        return F.max_by("value", F.when(mine, order))

    named = [last(v).alias(v) for v in VALUES]
    rows = inputs.where("coalesce(account_id, '') <> ''").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ACCOUNT], "value_type", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("is_delete", F.lit(False)).alias("is_delete"), "synced_at", "version")
    return rows.groupBy(*ACCOUNT).agg(
        F.max_by("is_delete", order).alias("is_closed"), *named, last("parent_email").alias("manager_email"), last("id", F.length("value") <= ID_LENGTH).alias("binding_id"),
    )


def _composed() -> Column:
    return F.trim(F.concat_ws(" ", "first_name", "last_name"))


def order_label() -> Column:
    """What an account is shown as and listed by, in lower case: address, username, name, name in parts, id."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.lower(F.coalesce(some(F.col("email")), some(F.col("username")), some(F.col("display_name")), some(_composed()), F.col("account_id")))


def list_accounts(folded: DataFrame, needle: str = "", after: tuple[str, str, str, str] | None = None, size: int = PAGE) -> DataFrame:
    """Up to size + 1 open accounts by label and account, after a key: one row over the size tells that there is more.

    A needle stands anywhere in address, username, id, name or name in parts, in any case, or begins a segment of the source's name.
    """
    rows = folded.where("not is_closed").withColumn("label", order_label())
    if needle:
        low = F.lit(needle.lower())
        inside = [F.contains(F.lower(F.coalesce(c, F.lit(""))), low) for c in (F.col("email"), F.col("username"), F.col("account_id"), F.col("display_name"), _composed())]
        segment = F.contains(F.lower(F.concat(F.lit("_"), F.replace("source_type", F.lit("-"), F.lit("_")))), F.lit("_" + needle.lower().replace("-", "_")))
        rows = rows.where(inside[0] | inside[1] | inside[2] | inside[3] | inside[4] | segment)
    if after:
        key = ["label", *ACCOUNT]
        rows = rows.where(F.col("label") >= after[0]).where(F.struct(*key) > F.struct(*[F.lit(v).alias(k) for k, v in zip(key, after, strict=True)]))
    return rows.orderBy("label", *ACCOUNT).limit(size + 1)


def review(evidence: DataFrame, bindings: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queue (kind, account, email, person_id, n_candidates) and the rates (observed, bound, excluded, no_evidence, no_source_id, pending) of open accounts.

    evidence: fold_evidence. bindings: account, person_id, provenance (operator, automatic, unconfirmed, roster). owners:
    email, person_id of addresses that a person is known to hold. Candidates are those to whom accounts of the same
    address are bound. An account without a binding is no_evidence without an address, contested with several candidates,
    no_source_id if neither its id, a candidate nor an owner leads to a person, else pending with no one's help needed. A
    bound one is open if it was made at login or from the roster and no operator has confirmed it; all of an address are a
    binding_conflict if it leads to several people and no operator has settled it.
    """
    a = evidence.where("not is_closed").withColumn("address", normal_email(F.col("email")))
    a = a.join(bindings.select(*ACCOUNT, "person_id", "provenance"), ACCOUNT, "left")
    held = a.where((F.col("person_id") != EXCLUDED) & F.col("address").isNotNull()).groupBy("address").agg(F.count_distinct("person_id").alias("n_candidates"), F.max(F.coalesce(F.col("provenance") == OPERATOR, F.lit(False))).alias("settled"))
    claimed = owners.where(F.col("person_id") != EXCLUDED).select(normal_email(F.col("email")).alias("address"), F.lit(True).alias("claimed")).distinct()
    a = a.join(held, "address", "left").join(claimed, "address", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    nobody = F.coalesce("binding_id", F.lit("")).eqNullSafe("") & (F.col("n_candidates") == 0) & F.col("claimed").isNull()
    state = (
        F.when(F.col("person_id") == EXCLUDED, "excluded").when(F.col("person_id").isNotNull(), "bound").when(F.col("address").isNull(), "no_evidence")
        .when(F.col("n_candidates") > 1, "contested").when(nobody, "no_source_id").otherwise("pending")
    )
    a = a.withColumn("state", state)
    confirmed = F.col("provenance") == OPERATOR
    own = F.when(F.col("state").isin("no_evidence", "contested", "no_source_id"), F.col("state")).when((F.col("state") == "bound") & ~confirmed & (F.col("provenance") == "unconfirmed"), "provisioned_at_login")
    own = own.when((F.col("state") == "bound") & ~confirmed & (F.col("provenance") == "roster"), "minted_from_roster")
    conflict = F.when((F.col("n_candidates") > 1) & ~F.coalesce("settled", F.lit(False)), "binding_conflict")
    queue = a.withColumn("kind", F.explode(F.filter(F.array(own, conflict), lambda k: k.isNotNull()))).select("kind", *ACCOUNT, "email", F.when(F.col("state") != "excluded", F.col("person_id")).alias("person_id"), "n_candidates")
    count = lambda *s: F.count_if(F.col("state").isin(*s))
    rates = a.agg(F.count("*").alias("observed"), count("bound").alias("bound"), count("excluded").alias("excluded"), count("no_evidence").alias("no_evidence"), count("no_source_id").alias("no_source_id"), count("pending", "contested").alias("pending"))
    return queue, rates


# -- decisions


class Refused(ValueError):
    """A call that can't be carried out as a whole."""


def _checked(wanted: DataFrame, people: DataFrame | None) -> DataFrame:
    twice = wanted.groupBy(*ACCOUNT).count().where("count > 1").limit(1).collect()
    if twice:
        raise Refused(f"account {twice[0]['source_type']}:{twice[0]['account_id']} appears more than once")
    n = wanted.limit(MOST_DECIDED + 1).count()
    if not 0 < n <= MOST_DECIDED:
        raise Refused(f"between 1 and {MOST_DECIDED} accounts are decided at once")
    if people is not None:
        if wanted.where(F.col("person_id") == EXCLUDED).limit(1).count():
            raise Refused("no account is bound to the excluded person")
        if wanted.join(people.select("person_id"), "person_id", "left_anti").limit(1).count():
            raise Refused("a person is unknown")
    return wanted


def decide(wanted: DataFrame, bindings: DataFrame, journal: DataFrame, at: Column, comment: str = "") -> DataFrame:
    """account, person_id, outcome, and for applied ones the journal's row: value_type, value_id, reason, created_at.

    An account that an operator has given to that person before is already_decided; to confirm what automation did is a
    decision of its own. created_at is `at`, or the microsecond after the last row of the same person, source and kind that
    is not before it, further ones for more accounts of a call: a slot that no other row has.
    """
    known = bindings.select(*ACCOUNT, F.col("person_id").alias("__known"), F.col("provenance").alias("__by"))
    slot = ["person_id", "source_type", "source_id"]
    out = wanted.join(known, ACCOUNT, "left").withColumn("outcome", F.when((F.col("__known") == F.col("person_id")) & (F.col("__by") == OPERATOR), ALREADY).otherwise(APPLIED)).drop("__known", "__by")
    taken = journal.where(F.col("value_type") == "id").groupBy(*slot).agg(F.max("created_at").alias("__last"))
    nth = F.row_number().over(Window.partitionBy(*slot, "outcome").orderBy("account_id"))
    start = F.greatest(F.unix_micros(at), F.coalesce(F.unix_micros("__last") + 1, F.lit(0)))
    applied = lambda c: F.when(F.col("outcome") == APPLIED, c)
    out = out.withColumn("__nth", nth).join(taken, slot, "left")
    return out.select(
        *ACCOUNT, "person_id", "outcome", applied(F.lit("id")).alias("value_type"), applied(F.col("account_id")).alias("value_id"), applied(F.lit(comment)).alias("reason"), applied(F.timestamp_micros(start + F.col("__nth") - 1)).alias("created_at"),
    )


def bind(wanted: DataFrame, people: DataFrame, bindings: DataFrame, journal: DataFrame, at: Column, comment: str = "") -> DataFrame:
    """Give accounts (account, person_id) to known people."""
    return decide(_checked(wanted, people), bindings, journal, at, comment)


def merge(source: str, target: str, people: DataFrame, bindings: DataFrame, journal: DataFrame, at: Column, comment: str = "") -> DataFrame:
    """Give all accounts of one person to another. However many they are: they are one decision."""
    if source == target or EXCLUDED in (source, target):
        raise Refused("two people are merged, and neither is the excluded one")
    if people.where(F.col("person_id").isin(source, target)).select("person_id").distinct().count() < 2:
        raise Refused("a person is unknown")
    wanted = bindings.where(F.col("person_id") == source).select(*ACCOUNT, F.lit(target).alias("person_id"))
    return decide(wanted, bindings, journal, at, comment)


def detach(account: DataFrame, new_person: Column, bindings: DataFrame, journal: DataFrame, at: Column, comment: str = "") -> DataFrame:
    """Take an account from its person and give it to a new one."""
    return decide(_checked(account.select(*ACCOUNT, new_person.alias("person_id")), None), bindings, journal, at, comment)


def exclude(accounts: DataFrame, bindings: DataFrame, journal: DataFrame, at: Column, comment: str = "") -> DataFrame:
    """Say of accounts that they are nobody's."""
    return decide(_checked(accounts.select(*ACCOUNT, F.lit(EXCLUDED).alias("person_id")), None), bindings, journal, at, comment)


def decided(bindings: DataFrame, decisions: DataFrame) -> DataFrame:
    """account, person_id, provenance after decisions: an operator's own stand."""
    new = decisions.where(F.col("outcome") == APPLIED).select(*ACCOUNT, "person_id", F.lit(OPERATOR).alias("provenance"))
    return bindings.select(*ACCOUNT, "person_id", "provenance").join(new, ACCOUNT, "left_anti").unionByName(new)
