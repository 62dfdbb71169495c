"""Evidence of version control: commits, changed files, pull requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import UNKNOWN, UNKNOWN_LABEL, dimension, dimensions
from ..functions.text import CATEGORY_NAMES, file_category, lookup
from ..operators.dedup import first_by_content, unique_mode
from . import evidence, measure

COMMIT = ["tenant_id", "source_id", "project_key", "repo_slug", "commit_hash"]
PULL = ["tenant_id", "source_id", "project_key", "repo_slug", "pr_id"]
#: What forges and change types are called.
SOURCES = {"github": "GitHub", "gitlab": "GitLab", "bitbucket_cloud": "Bitbucket Cloud"}
CHANGES = {"added": "Added", "modified": "Modified", "renamed": "Renamed", "deleted": "Deleted"}


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _place() -> list[Column]:
    """Repository, project and source as dimensions."""
    none = _text("project_key") == ""
    return [
        dimension("repository", F.concat(_text("source_id"), F.lit(":"), _text("project_key"), F.lit("/"), _text("repo_slug")), F.when(none, _text("repo_slug")).otherwise(F.concat_ws("/", "project_key", "repo_slug"))),
        dimension("project", F.when(none, UNKNOWN).otherwise(F.concat(_text("source_id"), F.lit(":"), "project_key")), F.when(none, UNKNOWN_LABEL).otherwise(F.col("project_key"))),
        dimension("source", F.col("data_source"), lookup(F.col("data_source"), SOURCES)),
    ]


def _known(value: Column, label: Column | None = None) -> tuple[Column, Column]:
    empty = F.coalesce(value, F.lit("")) == ""
    return F.when(empty, UNKNOWN).otherwise(F.lower(value)), F.when(empty, UNKNOWN_LABEL).otherwise(F.lower(value) if label is None else label)


def authored_commits(commits: DataFrame) -> DataFrame:
    """Commits that aren't merges, with an author's address and a date; a hash that a source has several times counts once."""
    own = commits.where("trim(author_email) <> '' and date is not null and not is_merge_commit")
    one = first_by_content(own, ["tenant_id", "data_source", "commit_hash"], ["source_id", "project_key", "repo_slug"])
    return one.withColumn("entity_id", F.lower(F.trim("author_email"))).withColumn("observed_at", F.col("date").cast("timestamp")).withColumn("metric_date", F.to_date("date"))


def unique_changes(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """One row for each content of a change, that of the earliest commit. Changes whose content is unknown stay one for each commit."""
    c = changes.join(commits.select(*COMMIT, "observed_at"), COMMIT)
    unknown = (_text("pre_image_oid") == "") & (_text("post_image_oid") == "")
    c = c.withColumn("__kind", F.lower("change_type")).withColumn("__own", F.when(unknown, F.col("commit_hash")).otherwise(""))
    content = ["tenant_id", "data_source", "project_key", "repo_slug", "file_path", "__kind", "pre_image_oid", "post_image_oid", "__own"]
    return first_by_content(c, content, ["observed_at", "commit_hash", "lines_added", "lines_removed"]).drop("__kind", "__own", "observed_at")


def commit_sizes(commits: DataFrame, changes: DataFrame, unique: DataFrame) -> DataFrame:
    """Commits with their lines less those of changes that another commit has: never below 0, and null where the source told none."""
    total = lambda df, a: df.groupBy(*COMMIT).agg(F.sum("lines_added").alias(f"{a}_added"), F.sum("lines_removed").alias(f"{a}_removed"))
    out = commits.join(total(changes, "all"), COMMIT, "left").join(total(unique, "own"), COMMIT, "left")
    for side in ("added", "removed"):
        lost = F.coalesce(f"all_{side}", F.lit(0)) - F.coalesce(f"own_{side}", F.lit(0))
        out = out.withColumn(f"lines_{side}", F.when(F.col(f"lines_{side}").isNotNull(), F.greatest(F.lit(0), F.col(f"lines_{side}") - lost)))
    return out.drop("all_added", "all_removed", "own_added", "own_removed")


def pull_authors(pulls: DataFrame, links: DataFrame, commits: DataFrame) -> DataFrame:
    """Pull requests with entity_id: the author's address, else the address of most of its commits if no other has as many."""
    own = commits.where("trim(author_email) <> '' and not is_merge_commit").select(*COMMIT, F.lower(F.trim("author_email")).alias("email")).distinct()
    of_commits = unique_mode(links.select(*PULL, "commit_hash").distinct().join(own, COMMIT), PULL, "email").select(*PULL, "email")
    stated = F.nullif(F.lower(F.trim("author_email")), F.lit(""))
    return pulls.join(of_commits, PULL, "left").withColumn("entity_id", F.coalesce(stated, "email")).drop("email")


def git_evidence(commits: DataFrame, changes: DataFrame, pulls: DataFrame, links: DataFrame) -> DataFrame:
    own = authored_commits(commits)
    unique = unique_changes(changes, own)
    sized = commit_sizes(own, changes, unique)
    size = F.col("lines_added") + F.col("lines_removed")
    of_commits = evidence(
        sized, "git", [measure("commit_count", F.lit(1)), measure("commit_lines_added", F.col("lines_added")), measure("commit_lines_removed", F.col("lines_removed")), measure("commit_change_size", size, size > 0)],
        F.concat_ws(":", "data_source", "commit_hash"), F.left("commit_hash", F.lit(12)), dimensions(*_place()),
    )
    days = own.groupBy("tenant_id", "entity_id", "metric_date").agg(F.min("observed_at").alias("observed_at"))
    active = evidence(days, "git", [measure("commit_day", F.lit(1))], F.col("metric_date").cast("string"), F.col("metric_date"))
    kind, kind_label = _known(F.col("change_type"), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CHANGES.items() for x in kv]), F.lower("change_type")), "change_type"))
    ext, ext_label = _known(F.col("file_extension"))
    files = unique.select(*COMMIT, "lines_added", "lines_removed", file_category(F.col("file_path")).alias("category"), ext.alias("ext"), ext_label.alias("ext_label"), kind.alias("kind"), kind_label.alias("kind_label"))
    keys = [*COMMIT, "category", "ext", "ext_label", "kind", "kind_label"]
    files = files.groupBy(*keys).agg(F.sum("lines_added").alias("added"), F.sum("lines_removed").alias("removed")).join(own.select(*COMMIT, "entity_id", "metric_date", "observed_at", "data_source"), COMMIT)
    by_file = dimensions(dimension("category", F.col("category"), lookup(F.col("category"), CATEGORY_NAMES)), dimension("file_extension", F.col("ext"), F.col("ext_label")), dimension("change_type", F.col("kind"), F.col("kind_label")), *_place())
    of_files = evidence(files, "git", [measure("lines_added", F.col("added")), measure("lines_removed", F.col("removed")), measure("code_lines_added", F.col("added"), F.col("category") == "code")], F.concat_ws(":", "data_source", "commit_hash", "category", "ext", "kind"), F.col("commit_hash"), by_file)
    return of_commits.unionByName(active).unionByName(of_files).unionByName(pull_evidence(pull_authors(pulls, links, commits)))


def pull_evidence(pulls: DataFrame) -> DataFrame:
    """Counts by the day of creation and of merging; hours from one to the other for those merged no earlier than created."""
    branch, branch_label = F.when(_text("destination_branch") == "", UNKNOWN).otherwise(F.col("destination_branch")), F.when(_text("destination_branch") == "", UNKNOWN_LABEL).otherwise(F.col("destination_branch"))
    dims = dimensions(dimension("destination_branch", branch, branch_label), *_place())
    merged, size = F.col("state") == "MERGED", F.col("lines_added") + F.col("lines_removed")
    hours = F.when(merged & (F.col("closed_on") >= F.col("created_on")), (F.unix_millis(F.col("closed_on").cast("timestamp")) - F.unix_millis(F.col("created_on").cast("timestamp"))) / 3_600_000)
    rid = F.concat_ws(":", "source_id", "project_key", "repo_slug", F.col("pr_id").cast("string"))
    label = F.concat(F.lit("#"), F.col("pr_number").cast("string"))
    at = lambda c: pulls.withColumn("observed_at", F.col(c)).withColumn("metric_date", F.to_date(c))
    created = evidence(at("created_on"), "git", [measure("pr_created", F.lit(1)), measure("pr_created_merged", F.lit(1), merged), measure("pr_change_size", size, size > 0)], rid, label, dims)
    closed = evidence(at("closed_on"), "git", [measure("pr_merged", F.lit(1), merged), measure("pr_cycle_hours", hours)], rid, label, dims)
    return created.unionByName(closed)


def pull_facts(pulls: DataFrame) -> DataFrame:
    """Pull requests with state_norm, person_key (the author's address, else name, in lower case) and cycle_time_h; impossible times are null."""
    state, who = F.lower("state"), F.when(_text("author_email") != "", F.lower("author_email")).otherwise(F.lower("author_name"))
    hours = (F.unix_seconds("closed_on") - F.unix_seconds("created_on")) / 3600.0
    return pulls.withColumns({"state_norm": state, "person_key": who, "cycle_time_h": F.when((state == "merged") & (F.col("closed_on") >= F.col("created_on")), hours)})


def review_facts(reviews: DataFrame) -> DataFrame:
    """Reviews with the reviewer's name in lower case as person_key."""
    return reviews.withColumn("person_key", F.lower("reviewer_name"))


def file_change_facts(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Changed files with their category (tests are `spec` here, documents count as code) and their commit's person, time, week and kind; those without a commit go."""
    kind = file_category(F.col("file_path"))
    by_name = F.when(kind == "vendored", "vendored").when(F.col("file_path").rlike(r"(?i)(\.spec\.|\.test\.|__tests__/|/tests?/)"), "spec").when(F.lower("file_path").rlike(r"\.(lock|ya?ml|toml|cfg|ini)$"), "config").otherwise("code")
    own = commits.select(*COMMIT, "person_key", F.col("date").alias("committed_at"), F.date_trunc("week", "date").cast("date").alias("week"), "is_merge_commit")
    return changes.withColumn("file_category", by_name).join(own, COMMIT)
