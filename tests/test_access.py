import json

import pytest
from pyspark.sql import functions as F

from tablewright.operators import access as a
from tablewright.sources.declarations import read_declarations

# The declared groups and grants.
GROUPS = [
    ("data-eng-writers", "Can write to core data engineering tables", ["alice@company.com", "bob@company.com"], None),
    ("sales-analytics-readonly", "Read-only access to sales reporting tables", ["carol@company.com", "dave@company.com"], None),
    ("sensitive-translation-readers", "Can read machine-translated sensitive documents", ["erin@company.com", "frank@company.com"], None),
    ("translation-pipeline-writers", "Service identity for the batch translation pipeline", None, ["translation-pipeline"]),
    ("sales-table-creators", "Can create new tables under local.sales", ["alice@company.com"], None),
    ("table-definitions-writer", "Service identity for schema-contract deploys", None, ["table-definitions"]),
]
GRANTS = [
    ("data-eng-writers", "namespace", "local.sales", "modify"),
    ("sales-analytics-readonly", "table", "local.sales.orders", "select"),
    ("sales-analytics-readonly", "namespace", "local.sales_reporting", "select"),
    ("translation-pipeline-writers", "table", "local.content.translated_documents_sensitive", "modify"),
    ("sensitive-translation-readers", "table", "local.content.translated_documents_sensitive", "select"),
    ("sales-table-creators", "namespace", "local.sales", "create"),
    ("table-definitions-writer", "namespace", "local.sales", "create"),
]
GRANT_SCHEMA = "group_name string, resource_type string, resource_path string, permission string"


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame(
        GROUPS, "name string, description string, members array<string>, service_accounts array<string>"
    )


@pytest.fixture(scope="module")
def grants(spark):
    return spark.createDataFrame(GRANTS, GRANT_SCHEMA)


@pytest.fixture(scope="module")
def members(groups):
    return a.memberships(groups)


def test_memberships(members):
    found = {tuple(r) for r in members.collect()}
    assert len(found) == 9
    assert ("data-eng-writers", "email", "bob@company.com") in found
    assert ("translation-pipeline-writers", "service_account", "translation-pipeline") in found


def test_access_matrix(spark, grants, members):
    people = ["alice@company.com", "carol@company.com", "erin@company.com"]
    requests = spark.createDataFrame(
        [
            (f"{p}/{action}", "email", p, "local.sales.orders", action)
            for p in people
            for action in ("read", "write", "compact")
        ],
        "request_id string, kind string, principal string, table_path string, action string",
    )
    found = {r["request_id"]: r["outcome"] for r in a.check_access(requests, grants, members).collect()}
    assert found == {
        "alice@company.com/read": "allowed",
        "alice@company.com/write": "allowed",
        "alice@company.com/compact": "allowed",
        "carol@company.com/read": "allowed",
        "carol@company.com/write": "denied",
        "carol@company.com/compact": "denied",
        "erin@company.com/read": "not_found",
        "erin@company.com/write": "not_found",
        "erin@company.com/compact": "not_found",
    }


def test_namespace_grants_reach_future_and_nested_tables(spark, grants, members):
    requests = spark.createDataFrame(
        [
            (1, "email", "bob@company.com", "local.sales.orders_v9", "write"),
            (2, "email", "bob@company.com", "local.sales.eu.orders", "write"),
            (3, "email", "bob@company.com", "local.sales_reporting.daily", "read"),
            (4, "email", "dave@company.com", "local.sales_reporting.daily", "read"),
            (5, "service_account", "translation-pipeline", "local.content.translated_documents_sensitive", "write"),
            (6, "service_account", "table-definitions", "local.sales.orders", "read"),
            (7, "email", "bob@company.com", "local.sales.orders", "drop"),
        ],
        "request_id long, kind string, principal string, table_path string, action string",
    )
    found = {r["request_id"]: r["outcome"] for r in a.check_access(requests, grants, members).collect()}
    assert found == {
        1: "allowed", 2: "allowed", 3: "not_found", 4: "allowed", 5: "allowed", 6: "not_found", 7: "denied",
    }


def test_effective_access(spark, grants, members):
    tables = spark.createDataFrame(
        [("local.sales.orders",), ("local.sales.orders_v2",), ("local.content.translated_documents_sensitive",)],
        "table_path string",
    )
    found = {tuple(r) for r in a.effective_access(tables, grants, members).collect()}
    alice = {(t, p) for _, who, t, p in found if who == "alice@company.com"}
    assert alice == {
        ("local.sales.orders", "modify"),
        ("local.sales.orders", "create"),
        ("local.sales.orders_v2", "modify"),
        ("local.sales.orders_v2", "create"),
    }
    assert {(t, p) for _, who, t, p in found if who == "carol@company.com"} == {("local.sales.orders", "select")}
    warehouse = spark.createDataFrame([("data-eng-writers", "warehouse", "local", "select")], GRANT_SCHEMA)
    assert a.group_access(tables, warehouse).count() == 3


def test_rejected_grants(spark, groups, grants):
    assert a.rejected_grants(grants, groups).isEmpty()
    bad = spark.createDataFrame(
        [
            ("data-eng-writers", "table", "local.sales.orders", "write"),
            ("data-eng-writers", "view", "local.sales.orders", "select"),
            ("nobody", "view", "local.sales.orders", "write"),
            (None, "table", "local.sales.orders", "select"),
            ("data-eng-writers", "table", "local.sales.orders", None),
        ],
        GRANT_SCHEMA,
    )
    found = a.rejected_grants(grants.union(bad), groups)
    assert found.columns == [*grants.columns, "reason"]
    assert sorted(str((r["group_name"], r["permission"], r["reason"])) for r in found.collect()) == sorted(
        str(line)
        for line in [
            ("data-eng-writers", "write", "unknown permission"),
            ("data-eng-writers", "select", "unsupported resource type"),
            ("nobody", "write", "unknown group"),
            (None, "select", "unknown group"),
            ("data-eng-writers", None, "unknown permission"),
        ]
    )


def test_plans_only_add_and_end(spark, grants, members):
    held = grants.limit(3).union(spark.createDataFrame([("old", "table", "local.x.y", "select")], GRANT_SCHEMA))
    todo = a.missing_grants(grants, held)
    assert todo.count() == 4
    assert a.missing_grants(grants, held.union(todo.select(*held.columns))).isEmpty()
    nobody = members.limit(0)
    assert a.missing_memberships(members, nobody).count() == members.count()
    assert a.missing_memberships(members, members).isEmpty()


def test_lookups_and_misses(spark, members):
    roles = members.select("group_name").distinct().withColumn("role_id", F.xxhash64("group_name"))
    known = members.filter(F.col("kind") == "email").select("kind", "principal").distinct()
    identities = known.withColumn("subject_id", F.concat(F.lit("id-"), "principal"))
    resolved = a.resolved_memberships(members.filter("kind = 'email'"), roles, identities)
    assert resolved.count() == 7
    with pytest.raises(Exception, match="no principal (translation-pipeline|table-definitions)"):
        a.resolved_memberships(members, roles, identities).collect()
    assert set(resolved.columns) == {"group_name", "kind", "principal", "role_id", "subject_id"}
    misses = {r["principal"] for r in a.unresolved(members, identities, "principal").collect()}
    assert misses == {"translation-pipeline", "table-definitions"}


def test_a_grant_reaches_only_what_its_type_names(spark, groups):
    """A table and a namespace may share a path."""
    grants = spark.createDataFrame(
        [
            ("data-eng-writers", "table", "local.sales", "modify"),
            ("sales-analytics-readonly", "namespace", "local.sales.orders", "select"),
            ("sales-analytics-readonly", "table", "local.sales.orders", "modify"),
            ("sales-table-creators", "warehouse", "local.sales", "select"),
            ("sales-table-creators", "namespace", "local", "select"),
            ("sales-table-creators", "namespace", "local..x", "select"),
        ],
        GRANT_SCHEMA,
    )
    found = {(r["resource_type"], r["resource_path"]) for r in a.rejected_grants(grants, groups).collect()}
    assert found == {
        ("table", "local.sales"), ("warehouse", "local.sales"), ("namespace", "local"), ("namespace", "local..x"),
    }
    tables = spark.createDataFrame([("local.sales.orders",), ("local.sales.orders.daily",)], "table_path string")
    assert {tuple(r) for r in a.group_access(tables, grants).collect()} == {
        ("sales-analytics-readonly", "local.sales.orders", "modify"),
        ("sales-analytics-readonly", "local.sales.orders.daily", "select"),
    }


def test_a_person_and_a_service_account_of_one_name(spark):
    members = spark.createDataFrame(
        [("writers", "service_account", "bot"), ("readers", "email", "bot")], "group_name string, kind string, principal string"
    )
    grants = spark.createDataFrame(
        [("writers", "namespace", "local.sales", "modify"), ("readers", "namespace", "local.sales", "select")], GRANT_SCHEMA
    )
    requests = spark.createDataFrame(
        [(1, "email", "bot", "local.sales.orders", "write"), (2, "service_account", "bot", "local.sales.orders", "write")],
        "request_id long, kind string, principal string, table_path string, action string",
    )
    found = {r["request_id"]: r["outcome"] for r in a.check_access(requests, grants, members).collect()}
    assert found == {1: "denied", 2: "allowed"}
    tables = requests.select("table_path").distinct()
    assert {tuple(r) for r in a.effective_access(tables, grants, members).collect()} == {
        ("email", "bot", "local.sales.orders", "select"),
        ("service_account", "bot", "local.sales.orders", "modify"),
    }


def test_missing_groups(spark, groups):
    held = groups.select(F.col("name").alias("group_name")).limit(4)
    todo = a.missing_groups(groups, held)
    assert todo.count() == 2
    assert a.missing_groups(groups, held.union(todo)).isEmpty()


def test_orphans(spark):
    stored = spark.createDataFrame([("g", "1"), ("g", "2"), ("h", "9")], "group_name string, subject_id string")
    live = spark.createDataFrame([("1",), ("2",)], "subject_id string")
    assert [r["group_name"] for r in a.orphans(stored, live).collect()] == ["h"]


def reach(spark, tmp_path, tables, grants, members):
    path = str(tmp_path / "numbers")
    a.numbered_members(members).write.parquet(path)
    found = a.grant_reach(tables, grants, a.member_bitmaps(spark.read.parquet(path)))
    return {(r["table_path"], r["permission"]): r["principals"] for r in found.collect()}


def listed(tables, grants, members):
    rows = a.effective_access(tables, grants, members).groupBy("table_path", "permission").agg(F.count("*").alias("n"))
    return {(r["table_path"], r["permission"]): r["n"] for r in rows.collect()}


def test_reach_is_the_count_of_the_listing(spark, tmp_path, grants, members):
    tables = spark.createDataFrame([("local.sales.orders",), ("local.sales.other",), ("local.content.translated_documents_sensitive",)], "table_path string")
    found = reach(spark, tmp_path, tables, grants, members)
    assert found == listed(tables, grants, members)
    assert found["local.sales.orders", "modify"] == 2 and found["local.sales.orders", "select"] == 2


def test_reach_merges_principals_of_several_groups(spark, tmp_path):
    """100,000 principals over several bitmaps, in overlapping groups, with names of both kinds, and NULL."""
    people = spark.range(0, 100_000, 1, 4)
    name = F.col("id").cast("string").alias("principal")
    parts = [("all", "email", "id >= 0"), ("odd", "email", "id % 2 = 1"), ("few", "service_account", "id < 10"), ("low", "email", "id < 40000")]
    members = None
    for group, kind, which in parts:
        rows = people.filter(which).select(F.lit(group).alias("group_name"), F.lit(kind).alias("kind"), name)
        members = rows if members is None else members.unionByName(rows)
    extra = spark.createDataFrame([("few", "email", None), ("few", "email", None), ("few", None, "x")], "group_name string, kind string, principal string")
    members = members.unionByName(extra)
    grants = spark.createDataFrame(
        [("odd", "table", "w.s.t", "select"), ("low", "namespace", "w.s", "select"), ("few", "warehouse", "w", "select"),
         ("all", "table", "w.s.u", "modify"), ("nobody", "table", "w.s.u", "describe")],
        GRANT_SCHEMA,
    )
    tables = spark.createDataFrame([("w.s.t",), ("w.s.u",), ("w.x.y",)], "table_path string")
    found = reach(spark, tmp_path, tables, grants, members)
    assert found.pop(("w.s.u", "describe")) == 0
    assert found == listed(tables, grants, members)
    assert found["w.s.t", "select"] == 70_000 + 12


def test_reach_never_lists_members_per_table(spark, tmp_path):
    """A thousand tables granted to one group of 100,000: the join sees the group's bitmaps, not its members."""
    members = spark.range(0, 100_000, 1, 4).select(F.lit("g").alias("group_name"), F.lit("email").alias("kind"), F.col("id").alias("principal"))
    tables = spark.range(1000).select(F.concat(F.lit("w.s.t"), "id").alias("table_path"))
    grants = spark.createDataFrame([("g", "namespace", "w.s", "select")], GRANT_SCHEMA)
    path = str(tmp_path / "numbers")
    a.numbered_members(members).write.parquet(path)
    bitmaps = a.member_bitmaps(spark.read.parquet(path))
    per_group = bitmaps.count()
    assert per_group <= 4 + 8  # one for each 32,768 numbers, and one more for each part of the order
    assert a.group_access(tables, grants).join(bitmaps, "group_name").count() == 1000 * per_group
    found = a.grant_reach(tables, grants, bitmaps)
    assert found.count() == 1000 and found.agg(F.min("principals"), F.max("principals")).first()[:] == (100_000, 100_000)


# -- nested declarations ------------------------------------------------------

SPEC = {
    "groups": {
        name: {k: v for k, v in (("description", text), ("members", people), ("service_accounts", machines)) if v}
        for name, text, people, machines in GROUPS
    },
    "grants": [dict(zip(("group", "resource_type", "resource_path", "permission"), g)) for g in GRANTS],
}


def written(path, document):
    path.write_text(json.dumps(document, indent=2))
    return str(path)


def test_nested_declarations_are_the_flat_ones(spark, tmp_path, groups, grants):
    spec = read_declarations(spark, written(tmp_path / "access.json", SPEC))
    assert sorted(map(str, a.declared_groups(spec).collect())) == sorted(map(str, groups.collect()))
    assert sorted(a.declared_grants(spec).collect()) == sorted(grants.collect())
    parts = [written(tmp_path / f"{k}.json", {k: v}) for k, v in SPEC.items()]
    both = read_declarations(spark, *parts)
    assert a.declared_groups(both).count() == 6 and a.declared_grants(both).count() == 7


def test_what_is_no_declaration_fails_the_read(spark, tmp_path):
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        read_declarations(spark, written(tmp_path / "wrong.json", {"groups": ["a"]})).collect()


def test_reconciliation_of_an_empty_state_and_of_its_own_result(spark, groups, grants):
    more = grants.unionByName(
        spark.createDataFrame([("nobody", "table", "local.a.b", "select"), ("data-eng-writers", "table", "local.a", "select")], GRANT_SCHEMA)
    )
    nothing = (groups.select(F.col("name").alias("group_name")).limit(0), a.memberships(groups).limit(0), grants.limit(0))
    plan = a.reconciliation(groups.unionAll(groups), more.unionAll(more), *nothing)
    assert plan.columns == a.PLAN
    steps = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    assert steps == {"create_group": 6, "add_member": 9, "grant": 7, "reject": 2}
    reasons = {r["reason"] for r in plan.filter("step = 4").collect()}
    assert reasons == {"unknown group", "path does not fit the type"}
    state = [plan.filter(f"step = {i + 1}").select(*held.columns) for i, held in enumerate(nothing)]
    again = a.reconciliation(groups, more, *state)
    assert {r["step"] for r in again.collect()} == {4}
