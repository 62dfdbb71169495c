"""From accounts to persons: profiles, groups by address, assignments, and the observations that follow.

Everything is joins and aggregates over accounts; a person that is made gets an id that follows from its group's key, so that
doing it again makes the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The person that means "not a human", the types of identifiers and of texts, and their longest values.
EXCLUDED = "ffffffff-ffff-ffff-ffff-ffffffffffff"
ID_TYPES = ["id", "email", "username", "employee_id", "parent_email", "parent_id", "parent_person_id"]
TEXT_TYPES = ["display_name", "first_name", "last_name", "department", "division", "job_title", "status"]
ID_LENGTH, TEXT_LENGTH = 320, 512
ACCOUNT = ["source_type", "source_id", "account_id"]


def normal_email(email: Column) -> Column:
    """Lower case and nothing else: blanks around it make another address. Blank ones are none."""
    return F.when(F.trim(email) != "", F.lower(email))


def made_id(key: Column) -> Column:
    """A person's id that follows from the key, in the form of a UUID."""
    h = F.sha2(key, 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12))


def routed(kind: Column, value: Column) -> Column:
    """struct of value_id, value_text, value: an identifier, a text, or anything else; what is too long is none of them."""
    size, none = F.length(value), F.lit(None).cast("string")
    is_id, is_text = kind.isin(ID_TYPES), kind.isin(TEXT_TYPES)
    return F.struct(F.when(is_id & (size <= ID_LENGTH), value).alias("value_id"), F.when(is_text & (size <= TEXT_LENGTH), value).alias("value_text"), F.when(~is_id & ~is_text, value).otherwise(none).alias("value"))


def profiles(inputs: DataFrame) -> DataFrame:
    """For each account: latest_email (the latest that isn't blank), is_closed (the latest row deletes), has_id (states an id that can be kept).

    inputs: ACCOUNT, value_type, value, is_delete, synced_at, version.
    """
    order = F.struct("synced_at", "version", "value_type", "value")
    email = F.when((F.col("value_type") == "email") & (F.trim("value") != ""), order)
    has_id = (F.col("value_type") == "id") & ~F.col("is_delete") & (F.trim("value") != "") & (F.length("value") <= ID_LENGTH)
    return inputs.groupBy(*ACCOUNT).agg(F.max(email)["value"].alias("latest_email"), F.max_by("is_delete", order).alias("is_closed"), F.max(has_id).alias("has_id"))


def email_owners(observations: DataFrame) -> DataFrame:
    """email, person_id: whom the latest observation of an address names. observations: value_type, value, person_id, created_at."""
    e = observations.where("value_type = 'email'").withColumn("email", normal_email(F.col("value"))).where("email is not null")
    return e.groupBy("email").agg(F.max(F.struct("created_at", "person_id"))["person_id"].alias("person_id"))


def assignments(accounts: DataFrame, bindings: DataFrame, owners: DataFrame, roster: str | None = None) -> DataFrame:
    """accounts (from profiles) with person_id and outcome; person_id is null where the outcome is a skip.

    bindings: ACCOUNT, person_id, provenance (operator, automatic, or unconfirmed for a person that was made and that nobody
    confirmed). In this order: excluded accounts leave; accounts keep their own binding, but one that is unconfirmed gives way
    to another person whom the address names; a group bound to one person takes its other accounts along, a group bound to
    several takes none; an account without address is made a person only by the roster; then the address's person; then
    nothing for groups that are closed, or state no id; then a new person.
    """
    a = accounts.join(bindings.withColumnRenamed("person_id", "bound_to"), ACCOUNT, "left").withColumn("email", normal_email(F.col("latest_email")))
    a = a.withColumn("group_key", F.when(F.col("email").isNotNull(), F.concat(F.lit("e:"), "email")).otherwise(F.concat(F.lit("a:"), F.to_json(F.struct(*ACCOUNT)))))
    a = a.join(owners.where(F.col("person_id") != EXCLUDED).withColumnRenamed("person_id", "claimed_by"), "email", "left")
    excluded = F.coalesce(F.col("bound_to") == EXCLUDED, F.lit(False))
    yields = F.coalesce((F.col("provenance") == "unconfirmed") & (F.col("claimed_by") != F.col("bound_to")), F.lit(False))
    a = a.withColumn("excluded", excluded).withColumn("bound", F.col("bound_to").isNotNull() & ~yields & ~excluded)
    rest = F.when(~F.col("excluded"), F.lit(True))
    g = a.groupBy("group_key").agg(
        F.min(F.when(F.col("bound"), F.col("bound_to"))).alias("one"), F.max(F.when(F.col("bound"), F.col("bound_to"))).alias("other"), F.max(F.when(F.col("bound"), F.col("provenance") == "operator")).alias("settled"),
        F.min(F.when(rest, F.col("is_closed"))).alias("all_closed"), F.max(F.when(rest, F.col("has_id"))).alias("any_id"),
    )
    a = a.join(g, "group_key")
    from_roster = (F.col("source_type") == roster) & F.col("has_id") if roster else F.lit(False)
    outcome = (
        F.when(F.col("excluded"), "skipped_excluded")
        .when(F.col("one").isNotNull() & (F.col("one") == F.col("other")), "reused_known")
        .when(F.col("one").isNotNull() & F.col("bound"), F.when(F.col("settled"), "reused_known_settled").otherwise("reused_known_conflict"))
        .when(F.col("one").isNotNull(), "skipped_contested_email")
        .when(F.col("email").isNull() & ~from_roster, "skipped_no_email")
        .when(F.col("email").isNull() & F.col("is_closed"), "skipped_closed")
        .when(F.col("email").isNull(), "minted_from_roster")
        .when(F.col("claimed_by").isNotNull(), "linked_by_email")
        .when(F.col("all_closed"), "skipped_closed")
        .when(~F.col("any_id"), "skipped_no_source_id")
        .otherwise("minted")
    )
    person = (
        F.when(F.col("outcome") == "reused_known", F.col("one"))
        .when(F.col("outcome").startswith("reused_known_"), F.col("bound_to"))
        .when(F.col("outcome") == "linked_by_email", F.col("claimed_by"))
        .when(F.col("outcome").startswith("minted"), made_id(F.col("group_key")))
    )
    return a.withColumn("outcome", outcome).withColumn("person_id", person).select(*accounts.columns, "group_key", "person_id", "outcome")


def counters(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("outcome").agg(F.count("*").alias("accounts"), F.count_distinct("group_key").alias("groups"))


def observation_rows(assigned: DataFrame, inputs: DataFrame) -> DataFrame:
    """Rows to append to the person log: each upsert's value in its column, with person_id, reason and created_at.

    Times are moved on by microseconds until no two rows share person, source, type and time.
    """
    reason = F.when(F.col("outcome") == "linked_by_email", "auto-seed-link").when(F.col("outcome") == "minted_from_roster", "roster-mint").otherwise("")
    rows = inputs.where("not is_delete").join(assigned.where("person_id is not null").select(*ACCOUNT, "person_id", reason.alias("reason")), ACCOUNT)
    rows = rows.select("*", routed(F.col("value_type"), F.col("value")).alias("r")).where("r.value_id is not null or r.value_text is not null or r.value is not null")
    w = Window.partitionBy("person_id", "source_type", "source_id", "value_type", "synced_at").orderBy("account_id", "version", "value")
    moved = F.timestamp_micros(F.unix_micros("synced_at") + F.row_number().over(w) - 1)
    return rows.select("person_id", "value_type", "source_type", "source_id", "account_id", "r.value_id", "r.value_text", "r.value", "reason", moved.alias("created_at"))


def review_queue(assigned: DataFrame, bindings: DataFrame) -> DataFrame:
    """What an operator has to look at, in a fixed order: kind, account, group."""
    kind = (
        F.when(F.col("outcome") == "skipped_contested_email", "contested")
        .when(F.col("outcome") == "skipped_no_email", "no_evidence")
        .when(F.col("outcome") == "skipped_no_source_id", "no_source_id")
        .when(F.col("outcome") == "reused_known_conflict", "binding_conflict")
        .when(F.col("outcome") == "minted_from_roster", "minted_from_roster")
    )
    made = assigned.join(bindings.where("provenance = 'unconfirmed'").select(*ACCOUNT, F.lit(True).alias("unconfirmed")), ACCOUNT, "left")
    kind = F.coalesce(kind, F.when(F.col("unconfirmed"), F.lit("provisioned_at_login")))
    return made.withColumn("kind", kind).where("kind is not null and not is_closed").select("kind", *ACCOUNT, "group_key").orderBy("kind", *ACCOUNT)


def email_to_person(observations: DataFrame) -> DataFrame:
    """email, person_id for addresses that all who ever had them agree on; the excluded person claims none. Blanks around don't count here."""
    e = observations.where("value_type = 'email'").select(F.lower(F.trim("value")).alias("email"), "person_id").where((F.col("email") != "") & (F.col("person_id") != EXCLUDED))
    return e.groupBy("email").agg(F.min("person_id").alias("person_id"), F.max("person_id").alias("x")).where("person_id = x").drop("x")


def _order(observations: DataFrame) -> list[str]:
    """What tells later observations from earlier ones; `id` decides within an instant where there is one."""
    return ["created_at", *(c for c in ("id",) if c in observations.columns)]


def current_values(observations: DataFrame) -> DataFrame:
    """person_id, source_type, source_id, value_type, value, and when: the latest observation of each kind that each source has of a person, blank ones too. Repeats of an instant without an id: the greatest value."""
    order = _order(observations)
    best = F.max(F.struct(*order, "value")).alias("x")
    return observations.groupBy("person_id", "source_type", "source_id", "value_type").agg(best).select("person_id", "source_type", "source_id", "value_type", "x.value", *(f"x.{c}" for c in order))


def labels(observations: DataFrame) -> DataFrame:
    """person_id, label: display name, else first and last name, else username, else address, of the latest over all sources.

    A blank value counts when the latest is looked for and leaves its kind out then, so that no value shows which its source
    has taken back. People of whom nothing is left have a null label. The latest of each source's latest is the latest of
    all, so sources need no grouping of their own here.
    """
    kinds = ["display_name", "first_name", "last_name", "username", "email"]
    now = observations.where(F.col("value_type").isin(kinds))
    latest = lambda t: F.nullif(F.trim(F.max(F.when(F.col("value_type") == t, F.struct(*_order(now), "value")))["value"]), F.lit("")).alias(t)
    p = now.groupBy("person_id").agg(*map(latest, kinds))
    full = F.nullif(F.concat_ws(" ", "first_name", "last_name"), F.lit(""))
    return p.select("person_id", F.coalesce("display_name", full, "username", "email").alias("label"))


def account_persons(observations: DataFrame) -> DataFrame:
    """source_type, source_id, account_id, person_id, valid_from, valid_to: to whom each account belonged, by its `id` observations.

    Of those of one instant the last by `id` counts; a period ends where the account's next one begins, also where both name
    the same person. Null accounts have none. A window sorts the observations of one account, which can spill.
    """
    own = observations.where("value_type = 'id' and value is not null").withColumnRenamed("value", "account_id")
    last = own.groupBy(*ACCOUNT, "created_at").agg(F.max_by("person_id", "id").alias("person_id"))
    ends = F.lead("created_at").over(Window.partitionBy(*ACCOUNT).orderBy("created_at"))
    return last.select(*ACCOUNT, "person_id", F.col("created_at").alias("valid_from"), ends.alias("valid_to"))


def org_edges(status: DataFrame, parents: DataFrame) -> DataFrame:
    """person_id, parent_id, valid_from, valid_to: whom each person reports to, while it is active.

    status: person_id, at, active. parents: person_id, at, parent_id (null for none). Repeats of a state open no interval; a
    parent's period is cut to the active interval; active time before the first parent, or without one, has a null parent.
    """
    w = Window.partitionBy("person_id").orderBy("at")
    turns = status.withColumn("was", F.lag("active").over(w)).where("was is null or was <> active").withColumn("till", F.lead("at").over(w)).where("active").select("person_id", F.col("at").alias("a"), F.col("till").alias("b"))
    first = turns.groupBy("person_id").agg(F.min("a").alias("at")).join(parents.groupBy("person_id").agg(F.min("at").alias("p")), "person_id", "left").where("p is null or at < p").select("person_id", "at", F.lit(None).cast("string").alias("parent_id"))
    all_parents = parents.select("person_id", "at", F.col("parent_id").cast("string").alias("parent_id")).unionByName(first)
    changes = all_parents.withColumn("n", F.row_number().over(w)).withColumn("was", F.lag("parent_id").over(w)).where("n = 1 or not (parent_id <=> was)").withColumn("till", F.lead("at").over(w)).select("person_id", "parent_id", F.col("at").alias("c"), F.col("till").alias("d"))
    both = turns.join(changes, "person_id").where("(d is null or a < d) and (b is null or c < b)")
    return both.select("person_id", "parent_id", F.greatest("a", "c").alias("valid_from"), F.least("b", "d").alias("valid_to"))
