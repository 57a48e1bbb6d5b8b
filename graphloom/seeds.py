"""Rule tables: documented facts about the platform the corpus describes.

Every rule operator takes its rules as a DataFrame; these are the defaults.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Fixed values. They must equal the documented facts for the results to agree.
# ---------------------------------------------------------------------------

# (child kind, parent kind), in order of precedence.
OWNERSHIP = [
    ("Pod", "ReplicaSet"),
    ("ReplicaSet", "Deployment"),
    ("Pod", "StatefulSet"),
    ("Pod", "DaemonSet"),
    ("Pod", "Job"),
    ("Job", "CronJob"),
    ("Pod", "Node"),
    ("Service", "Endpoints"),
    ("Ingress", "Service"),
    ("Deployment", "ReplicaSet"),
]

# Verbs common to all resources that support the full set.
ALL_VERBS = ["get", "list", "watch", "create", "update", "patch", "delete"]
RBAC_GROUP = "rbac.authorization.k8s.io"

# (resource, API group, verbs)
RESOURCE_VERBS = [
    ("pods", "", ALL_VERBS),
    ("services", "", ALL_VERBS),
    ("deployments", "apps", ALL_VERBS),
    ("replicasets", "apps", ALL_VERBS),
    ("statefulsets", "apps", ALL_VERBS),
    ("daemonsets", "apps", ALL_VERBS),
    ("configmaps", "", ALL_VERBS),
    ("secrets", "", ALL_VERBS),
    ("namespaces", "", ["get", "list", "watch", "create", "delete"]),
    ("nodes", "", [*ALL_VERBS, "cordondrain"]),
    ("roles", RBAC_GROUP, [*ALL_VERBS, "bind"]),
    ("rolebindings", RBAC_GROUP, [*ALL_VERBS, "bind"]),
    ("clusterroles", RBAC_GROUP, [*ALL_VERBS, "bind"]),
    ("clusterrolebindings", RBAC_GROUP, [*ALL_VERBS, "bind"]),
    ("ingresses", "networking.k8s.io", ALL_VERBS),
    ("customresourcedefinitions", "apiextensions.k8s.io", ALL_VERBS),
]

# (component, component it talks to, what for)
COMPONENTS = [
    ("kube-apiserver", "etcd", "persists cluster state"),
    ("kube-scheduler", "kube-apiserver", "watches for unscheduled pods"),
    ("kube-controller-manager", "kube-apiserver", "reconciles desired state"),
    ("kubelet", "kube-apiserver", "reports node/pod status"),
    ("kube-proxy", "kube-apiserver", "watches Service/Endpoint changes"),
]
CONTROLLED_BY = "kube-apiserver"

# Domain tag -> keywords, in tag order.
DOMAIN_KEYWORDS = {
    "networking": ["service", "ingress", "networkpolicy", "dns", "endpoint", "cni", "proxy",
                   "loadbalancer"],
    "storage": ["volume", "persistentvolume", "persistentvolumeclaim", "storageclass", "csi",
                "ephemeral"],
    "security": ["rbac", "role", "secret", "serviceaccount", "admission", "policy",
                 "certificate", "authentication", "authorization"],
}

# (actor, what it does), in order.
APPLY_STEPS = [
    ("kubectl", "Reads manifest (YAML/JSON) from file/stdin"),
    ("kubectl", "Computes the object's REST mapping (apiVersion+Kind -> resource)"),
    ("kubectl", "Sends POST/GET to kube-apiserver (create or retrieve live object)"),
    ("kube-apiserver", "Runs authentication, authorization (RBAC) and admission control"),
    ("kube-apiserver", "Persists object to etcd"),
    ("kube-controller-manager/scheduler", "Reconcile controllers act on the new object"),
    ("kubelet", "Node kubelet schedules and starts containers via container runtime"),
]

# Reading order of the flow nodes; other flow nodes come last.
FLOW_ORDER = [
    "flow:kubectl",
    "flow:kube-apiserver",
    "flow:etcd",
    "flow:kube-controller-manager_scheduler",
    "flow:kubelet",
]

# Topical labels a model may assign.
CLUSTER_LABELS = ["networking", "storage", "security", "scheduling", "observability",
                  "workloads", "api", "cli", "extensibility"]

# Words a question's keywords leave out.
QUESTION_STOP_WORDS = ["what", "which", "resources", "related", "does", "this", "with", "from",
                       "into", "that", "when", "how", "are", "the", "for", "and", "concepts",
                       "kubernetes", "object", "api"]

# Preference orders used for ranking; types not listed come last.
MATCH_TYPE_ORDER = ["glossary", "api_object", "page", "concept"]
WALK_TYPE_ORDER = ["glossary", "page", "api_object", "concept", "role"]
RELATION_ORDER = ["references", "related_to", "api_for", "owns", "requires", "prerequisite_of"]
DEPENDENT_TYPES = ["api_for", "references", "related_to"]

# Node type -> site section; types not listed belong to the first section.
SITE_SECTIONS = ["docs", "api", "rbac", "relationships"]
TYPE_SECTION = {
    "glossary": "docs",
    "page": "docs",
    "concept": "docs",
    "api_object": "api",
    "api_path": "api",
    "role": "rbac",
    "controller": "relationships",
}
SITE_ROUTES = ["/", "/graph", "/explore", "/search", "/docs/", "/api/", "/rbac/",
               "/relationships/", "/learn/", "/start/", "/about/", "/dataset.json",
               "/index.json", "/llms.txt"]

# Node types with a full text dump; concepts get a sample.
DUMP_TYPES = ["glossary", "api_object", "page", "role", "controller"]

# ---------------------------------------------------------------------------


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark: SparkSession, columns: Sequence[str],
                  rows: Iterable[Sequence[object]]) -> DataFrame:
    """A small constant table.

    It is a literal relation, so the optimiser knows its exact row count and a
    broadcast of it is proven safe.
    """
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def _numbered(rows: Iterable[Sequence[object]]) -> list[tuple[object, ...]]:
    return [(i, *row) for i, row in enumerate(rows)]


def ownership(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ["rule_ord", "child", "parent"], _numbered(OWNERSHIP))


def resource_verbs(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ["rule_ord", "resource", "api_group", "verbs"],
                         _numbered(RESOURCE_VERBS))


def components(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ["rule_ord", "component", "target", "label"],
                         _numbered(COMPONENTS))


def apply_steps(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ["step", "actor", "description"], _numbered(APPLY_STEPS))
