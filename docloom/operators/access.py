"""Who may see which library: grants, groups, roles and listings; the only way to a scoped table.

Roles rank admin 3 > editor 2 > reader 1. Grants come to a user directly or through a group; the strongest
counts. Soft-deleted libraries are hidden from every check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("reader", "editor", "admin")
#: Days for which a deleted library can be restored; the label of a user's own library.
GRACE_DAYS, OWN = 14, "personal"


def rank(role: Column | str) -> Column:
    """1 to 3; 0 for anything else."""
    return F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col(role) if isinstance(role, str) else role), F.lit(0))


def user_roles(grants: DataFrame, group_grants: DataFrame, group_members: DataFrame) -> DataFrame:
    """user_id, library_id, role: the strongest of direct grants and those of the user's groups."""
    through = group_members.select("group_id", "user_id").join(group_grants.select("group_id", "library_id", "role"), "group_id").select("user_id", "library_id", "role")
    every = grants.select("user_id", "library_id", "role").unionByName(through)
    return every.where(rank("role") > 0).groupBy("user_id", "library_id").agg(F.max_by("role", rank("role")).alias("role"))


def readable_libraries(libraries: DataFrame, roles: DataFrame) -> DataFrame:
    """user_id, library_id, label, role, place: libraries that are not deleted, own first, then by slug (null last)."""
    own = F.col("owner_id") == F.col("user_id")
    label = F.when(own, OWN).otherwise(F.coalesce("slug", F.col("library_id").cast("string")))
    order = Window.partitionBy("user_id").orderBy(F.desc("_own"), F.asc_nulls_last("slug"), "library_id")
    return (
        roles.join(libraries.where("deleted_at is null"), "library_id")
        .select("user_id", "library_id", "slug", label.alias("label"), "role", F.coalesce(own, F.lit(False)).alias("_own"))
        .withColumn("place", F.row_number().over(order))
        .select("user_id", "library_id", "label", "role", "place")
    )


def holders(roles: DataFrame, libraries: DataFrame, least: str = "reader") -> DataFrame:
    """user_id, library_id pairs that hold at least a role on a library that is not deleted."""
    return roles.where(rank("role") >= ROLES.index(least) + 1).join(libraries.where("deleted_at is null"), "library_id", "left_semi").select("user_id", "library_id")


def library_lists(users: DataFrame, roles: DataFrame, libraries: DataFrame, least: str = "reader") -> DataFrame:
    """user_id, libraries: sorted ids of what each user holds with a role at least; an empty list where it is nothing."""
    held = holders(roles, libraries, least).groupBy("user_id").agg(F.sort_array(F.collect_set("library_id")).alias("libraries"))
    return users.select("user_id").join(held, "user_id", "left").select("user_id", F.coalesce("libraries", F.array().cast(held.schema["libraries"].dataType)).alias("libraries"))


def scoped(table: DataFrame, roles: DataFrame, libraries: DataFrame, user_id, library_id=None) -> DataFrame:
    """Rows of the libraries that a user reads, of one library where it is named. An empty user sees nothing."""
    if user_id is None:
        raise ValueError("no user in scope")
    mine = holders(roles.where(F.col("user_id") == user_id), libraries)
    if library_id is not None:
        mine = mine.where(F.col("library_id") == library_id)
    return table.join(mine.select("library_id"), "library_id", "left_semi")


def members(grants: DataFrame, invitations: DataFrame, users: DataFrame) -> DataFrame:
    """library_id, username, role, invited, place: granted and invited people; pending last, stronger roles first."""
    every = grants.select("library_id", "user_id", "role", F.lit(False).alias("invited")).unionByName(invitations.select("library_id", "user_id", "role", F.lit(True).alias("invited")))
    order = Window.partitionBy("library_id").orderBy("invited", F.desc(rank("role")), "username")
    return every.join(users.select("user_id", "username"), "user_id").withColumn("place", F.row_number().over(order)).select("library_id", "username", "role", "invited", "place")


def group_sizes(groups: DataFrame, group_members: DataFrame) -> DataFrame:
    """group_id, slug, members (0 for a group without any)."""
    counts = group_members.groupBy("group_id").agg(F.count("*").alias("members"))
    return groups.join(counts, "group_id", "left").select("group_id", "slug", F.coalesce("members", F.lit(0)).alias("members"))


def audit_listing(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events with the live names of actor and subject, else the names kept with the event, else empty."""
    names = users.select("user_id", "username")
    actor = names.select(F.col("user_id").alias("actor_id"), F.col("username").alias("_actor"))
    subject = names.select(F.col("user_id").alias("subject_id"), F.col("username").alias("_subject"))
    return (
        events.join(actor, "actor_id", "left")
        .join(subject, "subject_id", "left")
        .select("event_id", "at", F.coalesce("_actor", "actor_name", F.lit("")).alias("actor"), "action", F.coalesce("_subject", "subject_name", F.lit("")).alias("subject"))
    )


def purgeable(now: Column) -> Column:
    """Of a library: deleted longer than the days of grace ago."""
    return F.coalesce(F.col("deleted_at") < now - F.expr(f"INTERVAL {GRACE_DAYS} DAYS"), F.lit(False))


def deleted_libraries(libraries: DataFrame, grants: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """user_id, library_id, slug, deleted_at, purge_at, deleted_by: what each admin may still restore.

    Only direct grants count. ``deleted_by`` is a name, empty if its account is gone.
    """
    names = users.select(F.col("user_id").alias("deleted_by"), F.col("username").alias("_name"))
    waiting = libraries.where(F.col("deleted_at").isNotNull() & ~purgeable(now)).join(names, "deleted_by", "left")
    admins = grants.where("role = 'admin'").select("user_id", "library_id")
    return admins.join(waiting, "library_id").select(
        "user_id", "library_id", "slug", "deleted_at",
        (F.col("deleted_at") + F.expr(f"INTERVAL {GRACE_DAYS} DAYS")).alias("purge_at"), F.coalesce("_name", F.lit("")).alias("deleted_by"),
    )


def purged(table: DataFrame, libraries: DataFrame, now: Column) -> DataFrame:
    """The rows of a table with library_id that stay when purgeable libraries go."""
    return table.join(libraries.where(purgeable(now)).select("library_id"), "library_id", "left_anti")


def resolved(asked: DataFrame, readable: DataFrame) -> DataFrame:
    """user_id, asked, library_id, doc_id of the ids that name a library which the user reads; others give no row.

    ``asked`` has user_id, asked. What stands before the first slash is a label; an id without one is the user's own.
    """
    label = F.when(F.contains("asked", F.lit("/")), F.substring_index("asked", "/", 1)).otherwise(OWN)
    local = F.when(F.contains("asked", F.lit("/")), F.expr("substring(asked, locate('/', asked) + 1)")).otherwise(F.col("asked"))
    wanted = asked.select("user_id", "asked", label.alias("label"), local.alias("doc_id"))
    return wanted.join(readable.select("user_id", "label", "library_id"), ["user_id", "label"]).select("user_id", "asked", "library_id", "doc_id")


def chosen(readable: DataFrame, names: list[str]) -> DataFrame:
    """The readable libraries of one user under the given labels, or all without labels; an unknown label is an error."""
    if not names:
        return readable
    found = readable.where(F.col("label").isin(*names))
    known = {r.label for r in found.select("label").distinct().collect()}  # no more rows than names
    for name in names:
        if name not in known:
            raise ValueError(f"no readable library is named {name!r}")
    return found


def last_admin_blocked(roles: DataFrame) -> DataFrame:
    """library_id, user_id of admins whose leaving would leave a library without one."""
    admins = roles.where(F.col("role") == "admin")
    return admins.groupBy("library_id").agg(F.count("*").alias("n"), F.min("user_id").alias("user_id")).where("n = 1").select("library_id", "user_id")
