"""What each rule says about settings that are right, wrong, left out or of another type."""

import json

import pytest
from pyspark.sql import functions as F

from cloudtally.operators import policy

LABELLED = {"project": "garden", "env": "live", "owner": "team-soil", "estate": "gcp", "managed-by": "terraform"}
ISSUER = f"arn:aws:iam::400000000011:oidc-provider/{policy.GITHUB_ISSUER}"
SUBSCRIPTION = "/subscriptions/7d0e"
NAMED_GROUP = f"{SUBSCRIPTION}/resourceGroups/beds"


def tags(field, drop=(), **put):
    return {field: {**{k: v for k, v in LABELLED.items() if k not in drop}, **put}}


def inline(*statements):
    return {"policy": json.dumps({"Statement": list(statements)})}


def assumed_by(principal, **condition):
    return {**tags("tags_all"), "assume_role_policy": json.dumps({"Statement": [{"Principal": principal, "Condition": condition}]})}


def says(role, member):
    return {"role": role, "member": member}


# resource type, settings planned for it, rules that must speak (a rule twice if it must speak twice)
SETTINGS = [
    # tags, under the field each provider uses
    ("aws_sqs_queue", tags("tags_all"), ()),
    ("aws_sqs_queue", tags("tags_all", drop=("env", "owner")), ("tag-missing", "tag-missing")),
    ("aws_sqs_queue", tags("tags", drop=("env",)), ()),
    ("aws_sqs_queue", {"tags_all": "not an object"}, ()),
    ("google_pubsub_topic", tags("terraform_labels", owner="", project=""), ("tag-empty", "tag-empty")),
    ("google_pubsub_topic", tags("terraform_labels", estate="greenhouse"), ("tag-estate",)),
    ("google_pubsub_topic", tags("terraform_labels", estate=3), ("tag-estate",)),
    ("azurerm_subnet", tags("tags", drop=("estate",), env=False), ("tag-missing", "tag-missing")),
    ("azurerm_subnet", tags("tags", owner=None), ()),
    ("azurerm_subnet", tags("tags", estate=None), ("tag-estate",)),
    ("random_pet", tags("tags", drop=("env",)), ()),
    # ports open to everybody
    ("aws_vpc_security_group_ingress_rule", {"cidr_ipv4": "0.0.0.0/0", "from_port": 443}, ()),
    ("aws_vpc_security_group_ingress_rule", {"cidr_ipv4": "0.0.0.0/0", "from_port": 443.0}, ()),
    ("aws_vpc_security_group_ingress_rule", {"cidr_ipv4": "0.0.0.0/0", "from_port": 5432}, ("open-port",)),
    ("aws_vpc_security_group_ingress_rule", {"cidr_ipv4": "0.0.0.0/0", "from_port": "80"}, ("open-port",)),
    ("aws_vpc_security_group_ingress_rule", {"cidr_ipv4": "0.0.0.0/0", "from_port": None}, ("open-port",)),
    ("aws_vpc_security_group_ingress_rule", {"cidr_ipv4": "0.0.0.0/0"}, ()),
    ("aws_vpc_security_group_ingress_rule", {"cidr_ipv4": "10.4.0.0/16", "from_port": 5432}, ()),
    # settings that must be on or off on purpose
    ("aws_lb_listener", {"protocol": "HTTP"}, ("plain-http-listener",)),
    ("aws_lb_listener", {"protocol": "TLS"}, ()),
    ("google_storage_bucket", {}, ("bucket-public-access", "bucket-object-acls")),
    ("google_storage_bucket", {"public_access_prevention": "enforced", "uniform_bucket_level_access": "true"}, ("bucket-object-acls",)),
    ("google_storage_bucket", {"public_access_prevention": None, "uniform_bucket_level_access": True}, ("bucket-public-access",)),
    ("azurerm_container_registry", {"admin_enabled": False}, ()),
    ("azurerm_container_registry", {"admin_enabled": "false"}, ("registry-admin-user",)),
    ("azurerm_container_registry", {}, ("registry-admin-user",)),
    ("azurerm_container_app", {"ingress": []}, ()),
    ("azurerm_container_app", {"ingress": [{"allow_insecure_connections": False}, {"target_port": 8000}]}, ("ingress-plain-http",)),
    ("aws_ecr_repository", {"image_tag_mutability": "IMMUTABLE"}, ()),
    ("aws_ecr_repository", {"image_tag_mutability": "IMMUTABLE_WITH_EXCLUSION"}, ("ecr-mutable-tags",)),
    ("google_artifact_registry_repository", {"format": "PYTHON"}, ()),
    ("google_artifact_registry_repository", {"docker_config": [{"immutable_tags": True}]}, ()),
    ("google_artifact_registry_repository", {"docker_config": []}, ("artifact-mutable-tags",)),
    # what a policy document grants
    ("aws_iam_role_policy", inline({"Action": "sqs:SendMessage", "Resource": "arn:aws:sqs:*:*:beds"}), ()),
    ("aws_iam_role_policy", inline({"Action": ["sqs:*", "sns:Pub*"], "Resource": "arn:q"}), ("wildcard-action", "wildcard-action")),
    ("aws_iam_role_policy", inline({"Action": "sqs:ListQueues", "Resource": ["arn:q", "*"]}), ("star-resource",)),
    ("aws_iam_role_policy", inline({"Action": ["logs:Describe*", "ssmmessages:OpenDataChannel"], "Resource": "*"}), ()),
    ("aws_iam_role_policy", inline({"Action": "*", "Resource": "*"}), ("wildcard-action", "star-resource")),
    ("aws_iam_role_policy", {"policy": '{"Statement": ['}, ()),
    ("aws_sqs_queue_policy", inline({"Action": "*", "Resource": "*"}), ()),
    # who may become a role
    ("aws_iam_role", assumed_by({"Federated": ISSUER}, StringEquals={f"{policy.GITHUB_ISSUER}:sub": "repo:acme/beds:ref:refs/heads/live"}), ()),
    ("aws_iam_role", assumed_by({"Federated": ISSUER}, StringLike={f"{policy.GITHUB_ISSUER}:sub": "repo:acme/*"}), ("github-trust",)),
    ("aws_iam_role", assumed_by({"Federated": ISSUER}, StringEquals={f"{policy.GITHUB_ISSUER}:aud": "sts"}), ("github-trust",)),
    ("aws_iam_role", assumed_by({"Service": "ecs-tasks.amazonaws.com"}), ()),
    # grants on the other two providers
    ("google_project_iam_member", says("roles/viewer", "group:soil@garden.test"), ("google-basic-role",)),
    ("google_project_iam_member", says("roles/owner", "allUsers"), ("google-basic-role", "google-public-member")),
    ("google_bigquery_dataset_iam_member", says("roles/bigquery.dataViewer", "allAuthenticatedUsers"), ("google-public-member",)),
    ("google_cloud_run_v2_service_iam_member", says("roles/run.invoker", "allUsers"), ()),
    ("google_project_iam_binding", says("roles/owner", "allUsers"), ()),
    ("google_service_account_key", {}, ("service-account-key",)),
    ("azurerm_role_assignment", {"role_definition_name": "Owner", "scope": NAMED_GROUP + "/providers/X/vaults/v"}, ("azure-broad-role",)),
    ("azurerm_role_assignment", {"role_definition_name": "Reader", "scope": SUBSCRIPTION + "/"}, ("azure-subscription-scope",)),
    ("azurerm_role_assignment", {"role_definition_name": "Reader", "scope": NAMED_GROUP}, ()),
    ("azurerm_role_assignment", {"role_definition_name": "Key Vault Reader", "scope": NAMED_GROUP + "/"}, ("azure-group-scope",)),
    (
        "azurerm_role_assignment",
        {"role_definition_name": "User Access Administrator", "scope": SUBSCRIPTION},
        ("azure-broad-role", "azure-subscription-scope"),
    ),
]


def resource(kind, after, *actions, nr=0):
    return {"address": f"module.m.{kind}.n{nr}", "type": kind, "change": {"actions": list(actions or ("create",)), "after": after}}


def planned(spark, **roots):
    """A plan document per root, each a list of resources."""
    rows = [(root, json.dumps({"resource_changes": changes})) for root, changes in roots.items()]
    return spark.createDataFrame(rows, "root string, plan string")


@pytest.fixture(scope="module")
def spoken(spark):
    """All settings above as one plan; {number: rules that spoke}."""
    whole = planned(spark, one=[resource(kind, after, nr=i) for i, (kind, after, _) in enumerate(SETTINGS)])
    out = {}
    for r in policy.plan_findings(whole).collect():
        out.setdefault(int(r["address"].rpartition(".n")[2]), []).append(r["rule"])
    return out


@pytest.mark.parametrize("nr", range(len(SETTINGS)))
def test_what_a_rule_says(spoken, nr):
    # Rules about tags speak only where the settings are about tags.
    assert sorted(spoken.get(nr, ())) == sorted(SETTINGS[nr][2])


def test_levels_and_number_of_rules():
    levels = list(policy.RULES.values())
    assert (len(levels), levels.count("warn"), policy.RULES["plain-http-listener"]) == (20, 1, "warn")


def test_every_rule_is_tried_both_ways():
    tried = {rule for *_, rules in SETTINGS for rule in rules}
    assert tried == set(policy.RULES)


def test_what_will_not_exist_is_not_scanned(spark):
    key = "google_service_account_key"
    rows = planned(
        spark, gone=[resource(key, None, "delete")], untouched=[resource(key, None, "no-op")], swapped=[resource(key, {}, "create", "delete")],
        kept=[resource(key, {}, "update")], void=[resource(key, None, "create")],
    )
    roots = lambda **how: {r["root"] for r in policy.plan_findings(rows, **how).collect()}
    assert roots() == {"kept"}
    assert roots(include_replacements=True) == {"kept", "swapped"}


def test_a_rule_without_a_port_is_named_when_asked(spark):
    rows = planned(spark, r=[resource("aws_vpc_security_group_ingress_rule", {"cidr_ipv4": "0.0.0.0/0"})])
    found = policy.plan_findings(rows, strict_ports=True).collect()
    assert [r["message"] for r in found] == ["module.m.aws_vpc_security_group_ingress_rule.n0 opens port any to the internet"]


def test_messages_name_resource_and_value(spark):
    rows = planned(spark, r=[resource("google_pubsub_topic", tags("terraform_labels", drop=("owner",), estate="shed"))])
    assert {r["message"] for r in policy.plan_findings(rows).collect()} == {
        "module.m.google_pubsub_topic.n0 has no owner tag",
        'module.m.google_pubsub_topic.n0 has estate "shed", which is not one of hub, gcp, aws or azure',
    }


def test_repeated_resources_count_once_and_quiet_roots_stay(spark):
    rows = planned(spark, hub=[resource("google_service_account_key", {})] * 3, aws=[resource("random_pet", {})])
    got = {r["root"]: r for r in policy.verdicts(policy.plan_findings(rows), ["hub", "aws", "gcp"]).collect()}
    assert {k: (r["failures"], r["rules_passed"], r["verdict"]) for k, r in got.items()} == {
        "hub": (1, 19, "fail"), "aws": (0, 20, "pass"), "gcp": (0, 20, "pass")
    }


def test_a_root_nobody_listed_is_reported(spark):
    rows = planned(spark, stray=[resource("aws_lb_listener", {"protocol": "HTTP"})])
    got = {r["root"]: r["verdict"] for r in policy.verdicts(policy.plan_findings(rows), ["hub"]).collect()}
    assert got == {"hub": "pass", "stray": "warn"}


@pytest.mark.parametrize("text", ['{"resource_changes": [{"addr', "", None, "null", "[]", '"text"'])
def test_a_plan_that_cannot_be_read_fails(spark, text):
    rows = spark.createDataFrame([("hub", text), ("aws", '{"format_version": "1.2"}')], "root string, plan string")
    got = {r["root"]: (r["failures"], r["rules_passed"], r["verdict"]) for r in policy.verdicts(policy.plan_findings(rows), ["hub", "aws"]).collect()}
    assert got == {"hub": (1, 0, "fail"), "aws": (0, 20, "pass")}


def test_rules_run_in_one_scan_and_shuffle_findings_only(spark):
    found = policy.findings(policy.planned_resources(planned(spark, r=[resource("google_storage_bucket", {})])))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert found.filter(F.col("level") == "deny").count() == 2


@pytest.mark.parametrize(
    ("actions", "plain", "with_replacements"),
    [
        (["create", None], 1, 1), ([None], 1, 1), (None, 1, 1), (["delete", None], 0, 0), (["delete", "create"], 0, 1),
        ([None, "delete", "create"], 0, 1), ("delete", 0, 0), ("create", 1, 1), ([], 1, 1), ([1, "update"], 1, 1),
    ],
)
def test_what_is_among_the_actions(spark, actions, plain, with_replacements):
    change = {"address": "a.b", "type": "aws_sqs_queue", "change": {"actions": actions, "after": {"tags_all": {}}}}
    plans = spark.createDataFrame([("hub", json.dumps({"resource_changes": [change]}))], "root string, plan string")
    assert policy.planned_resources(plans).count() == plain
    assert policy.planned_resources(plans, include_replacements=True).count() == with_replacements


def test_a_plan_without_a_list_of_changes_plans_nothing(spark):
    plans = spark.createDataFrame([("hub", t) for t in ("{}", '{"resource_changes": {}}')], "root string, plan string")
    assert policy.planned_resources(plans).count() == 0
    assert policy.plan_findings(plans).count() == 0
