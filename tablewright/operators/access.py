"""Access declarations as data: members, grants, what is missing, who may do what.

Inputs are DataFrames. Declarations may come nested, as they are written in a file
(:data:`SPEC`, :func:`declared_groups`, :func:`declared_grants`); flat, they are:

* groups       ``name, description, members array<string>, service_accounts array<string>``
* grants       ``group_name, resource_type, resource_path, permission``
* tables       ``table_path`` (``warehouse.namespace.table``)
* memberships  ``group_name, kind, principal``; a person and a service account of one
  name are two principals
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import ancestor_paths
from tablewright.operators.relational import anti_join, look_up, missing, single

# The vocabulary of grants, and what a granted permission allows.
RESOURCE_TYPES = ["warehouse", "namespace", "table"]
PERMISSIONS = ["describe", "select", "create", "modify", "ownership", "pass_grants", "manage_grants"]
ALLOWED_ACTIONS = {"select": ["read"], "modify": ["read", "write", "compact"]}

# The nested form of declarations.
SPEC = (
    "groups map<string, struct<description: string, members: array<string>, service_accounts: array<string>>>, "
    "grants array<struct<group: string, resource_type: string, resource_path: string, permission: string>>"
)

GRANT_KEY = ["group_name", "resource_type", "resource_path", "permission"]
MEMBER_KEY = ["group_name", "kind", "principal"]
PRINCIPAL = ["kind", "principal"]
LEVEL = ["resource_type", "resource_path"]


def declared_groups(spec: DataFrame) -> DataFrame:
    """The groups of nested declarations; any number of documents, each with any number of groups.

    A group that several documents declare is one row for each. Documents without groups add none.
    """
    listed = spec.select(F.explode("groups").alias("name", "group"))
    return listed.select("name", "group.description", "group.members", "group.service_accounts")


def declared_grants(spec: DataFrame) -> DataFrame:
    """The grants of nested declarations. Documents without grants add none."""
    return spec.select(F.inline("grants")).withColumnRenamed("group", "group_name")


def memberships(groups: DataFrame) -> DataFrame:
    """One row per group, kind of principal and principal; repeats are merged."""
    flat = groups.select(
        F.col("name").alias("group_name"),
        F.explode(
            F.array(
                F.struct(F.lit("email").alias("kind"), F.col("members").alias("names")),
                F.struct(F.lit("service_account").alias("kind"), F.col("service_accounts").alias("names")),
            )
        ).alias("listed"),
    )
    return flat.select("group_name", "listed.kind", F.explode("listed.names").alias("principal")).distinct()


def levels_of(path: Column | str) -> Column:
    """The steps of a table's path with the type of grant that reaches each.

    The first is the warehouse, the last the table itself, what lies between a namespace.
    """
    paths = ancestor_paths(path)
    kind = lambda at: (
        F.when(at == F.size(paths) - 1, "table").when(at == 0, "warehouse").otherwise("namespace")
    )
    return F.transform(paths, lambda step, at: F.struct(kind(at).alias("resource_type"), step.alias("resource_path")))


def rejected_grants(grants: DataFrame, groups: DataFrame) -> DataFrame:
    """Grants that cannot be applied, each with the first rule it breaks.

    A warehouse's path has one step, a namespace's two or more, a table's three or more.
    """
    depth = F.size(F.split("resource_path", r"\."))
    deep_enough = (
        F.when(F.col("resource_type") == "warehouse", depth == 1)
        .when(F.col("resource_type") == "namespace", depth >= 2)
        .otherwise(depth >= 3)
    )
    whole = ~F.col("resource_path").rlike(r"(^|\.)(\.|$)")
    reason = (
        F.when(~F.coalesce(F.col("permission").isin(PERMISSIONS), F.lit(False)), "unknown permission")
        .when(~F.coalesce(F.col("resource_type").isin(RESOURCE_TYPES), F.lit(False)), "unsupported resource type")
        .when(~F.coalesce(deep_enough & whole, F.lit(False)), "path does not fit the type")
    )
    names = groups.select(F.col("name").alias("group_name"))
    undeclared = grants.join(names, "group_name", "left_anti").withColumn("reason", F.lit("unknown group"))
    others = grants.withColumn("reason", reason).filter("reason IS NOT NULL").join(names, "group_name", "left_semi")
    return undeclared.unionByName(others).select(*grants.columns, "reason")


def missing_groups(groups: DataFrame, existing: DataFrame) -> DataFrame:
    """Declared group names that ``existing(group_name)`` lacks; they come before their members."""
    return missing(groups.select(F.col("name").alias("group_name")), existing, ["group_name"])


def missing_memberships(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """Memberships to add; nothing is ever taken away."""
    return missing(desired, existing, MEMBER_KEY)


def missing_grants(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """Grants to add; nothing is ever taken away."""
    return missing(desired, existing, GRANT_KEY)


PLAN = ["step", "action", *MEMBER_KEY, *GRANT_KEY[1:], "reason"]


def reconciliation(
    groups: DataFrame, grants: DataFrame, held_groups: DataFrame, held_members: DataFrame, held_grants: DataFrame
) -> DataFrame:
    """What brings a stored state to the declared one, as one table of steps; nothing is ever taken away.

    ``step, action, group_name, kind, principal, resource_type, resource_path, permission,
    reason``, NULL where an action has no such thing. Groups are created (1) before members
    are added (2), both before grants are given (3); grants that cannot be applied are
    listed with their reason (4) and given to nobody. Repeated declarations are one step,
    and a second run on the state that the first one makes has no steps 1 to 3.
    """
    applied = grants.select(*GRANT_KEY)
    refused = rejected_grants(applied, groups).select(*GRANT_KEY, "reason").distinct()
    fine = missing(applied, refused, GRANT_KEY)
    steps = [
        (1, "create_group", missing_groups(groups, held_groups)),
        (2, "add_member", missing_memberships(memberships(groups), held_members)),
        (3, "grant", missing_grants(fine, held_grants)),
        (4, "reject", refused),
    ]
    text = lambda df, name: F.col(name).cast("string").alias(name) if name in df.columns else F.lit(None).cast("string").alias(name)
    rows = [
        df.select(F.lit(step).alias("step"), F.lit(action).alias("action"), *[text(df, name) for name in PLAN[2:]])
        for step, action, df in steps
    ]
    return reduce(DataFrame.unionAll, rows)


def resolved_memberships(members: DataFrame, roles: DataFrame, identities: DataFrame) -> DataFrame:
    """Memberships with ids: ``roles(group_name, role_id)``, ``identities(kind, principal, subject_id)``.

    A group or principal that is not known, or known by two ids, is an error;
    :func:`unresolved` lists the unknown ones.
    """
    with_roles = look_up(members, single(roles, ["group_name"]), "group_name", required=True)
    return look_up(with_roles, single(identities, PRINCIPAL), PRINCIPAL, required=True)


def unresolved(members: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Memberships whose group or principal is not known: the misses of the lookup."""
    return anti_join(members, known, on)


def orphans(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored memberships whose ``subject_id`` no longer belongs to a live identity."""
    return anti_join(stored, live, "subject_id")


def group_access(tables: DataFrame, grants: DataFrame) -> DataFrame:
    """What each group holds on each table, directly or from a level above."""
    levels = tables.select("table_path", F.inline(levels_of("table_path")))
    held = grants.select("group_name", *LEVEL, "permission").distinct()
    return levels.join(held, LEVEL).select("group_name", "table_path", "permission").distinct()


def effective_access(tables: DataFrame, grants: DataFrame, members: DataFrame) -> DataFrame:
    """Every principal's permissions on every table.

    The listing is as large as its answer; :func:`check_access` answers requests
    without it. Groups and tables are joined before the members come in, and a
    large group is split at run time.
    """
    belongs = members.select(*MEMBER_KEY).distinct()
    access = group_access(tables, grants)
    return belongs.join(access, "group_name").select(*PRINCIPAL, "table_path", "permission").distinct()


def numbered_members(members: DataFrame) -> DataFrame:
    """``group_name, number`` for each membership; a principal has one number, whatever its groups.

    Numbers follow the order of a principal's first group, so the members of a group
    stand close together and fill few bitmaps. The caller stores the result, as numbers
    are given by partition.
    """
    belongs = members.select(*MEMBER_KEY).distinct()
    first = belongs.groupBy(*PRINCIPAL).agg(F.min("group_name").alias("_first"))
    ordered = first.repartitionByRange("_first", *PRINCIPAL).sortWithinPartitions("_first", *PRINCIPAL)
    numbers = ordered.select(*PRINCIPAL, F.monotonically_increasing_id().alias("number"))
    same = belongs["kind"].eqNullSafe(numbers["kind"]) & belongs["principal"].eqNullSafe(numbers["principal"])
    return belongs.join(numbers, same).select("group_name", "number")


def member_bitmaps(numbered: DataFrame) -> DataFrame:
    """``group_name, bucket, bits``: a group's members as bitmaps of 32,768 numbers each."""
    bucket = F.bitmap_bucket_number("number").alias("bucket")
    return numbered.groupBy("group_name", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def grant_reach(tables: DataFrame, grants: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``table_path, permission, principals``: how many principals hold each permission on each table.

    The counts of :func:`effective_access` without its listing: the bitmaps of a table's
    groups are united, so a member of several counts once, and a group's members are one
    row per bitmap however often the group is granted. Permissions that reach a table
    through groups without members count 0.
    """
    held = group_access(tables, grants)
    joined = held.join(bitmaps, "group_name", "left")
    united = joined.groupBy("table_path", "permission", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    counted = F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits")).otherwise(0))
    return united.groupBy("table_path", "permission").agg(counted.alias("principals"))


def check_access(requests: DataFrame, grants: DataFrame, members: DataFrame) -> DataFrame:
    """An outcome for each ``request_id, kind, principal, table_path, action``.

    ``allowed``, ``denied`` (the table is visible but the action is not granted)
    or ``not_found`` (no grant reaches the table). ``request_id`` is unique. A grant
    reaches a table through its own path and type only: a table's grant says nothing
    about a namespace of the same path. Work is one row per request, group of its
    principal and level of its path; how many members a group has, or how many groups
    a path is granted to, does not matter.
    """
    allows = F.create_map(
        *[
            part
            for permission, actions in ALLOWED_ACTIONS.items()
            for part in (F.lit(permission), F.array(*[F.lit(a) for a in actions]))
        ]
    )
    held = grants.filter(F.col("permission").isin(list(ALLOWED_ACTIONS))).select(
        "group_name", *LEVEL, allows[F.col("permission")].alias("actions")
    )
    belongs = members.select(*MEMBER_KEY).distinct()
    asked = requests.join(belongs, PRINCIPAL, "left").select(
        *requests.columns, "group_name", F.inline(levels_of("table_path"))
    )
    may = F.bool_or(F.array_contains("actions", F.col("action")))
    outcome = F.when(F.col("granted"), "allowed").when(~F.col("granted"), "denied").otherwise("not_found")
    return (
        asked.join(held, ["group_name", *LEVEL], "left")
        .groupBy(*requests.columns)
        .agg(may.alias("granted"))
        .select(*requests.columns, outcome.alias("outcome"))
    )
