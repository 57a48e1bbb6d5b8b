"""A small corpus and API description of our own, written to a folder."""

import json
import os


def tip(term, text=None):
    shown = f'text="{text}" ' if text else ""
    return '{{< glossary_tooltip ' + shown + f'term_id="{term}" >}}}}'


def term_doc(term, tags, text):
    title = term.capitalize()
    listed = "\n".join(f"- {t}" for t in tags)
    return (
        f'---\ntitle: "{title}"\nid: {term}\nfull_link: /docs/about/{term}/\n'
        f"short_description: >\n  What a {term} is about.\ntags:\n{listed}\n---\n{text}\n"
    )


PAGE = "\n".join([
    "---",
    'title: "Deployments"',
    "weight: 20",
    "description: >",
    "  Running replicas and",
    "  making them reachable.",
    "---",
    "# Deployments",
    "",
    f"Use a {tip('deployment', 'Deployment')} to keep several {tip('pod', 'Pods')} alive.",
    "",
    "## Make it reachable",
    "",
    f"1. Add a {tip('service', 'Service')}.",
    f"2. Perhaps add an {tip('ingress', 'Ingress')} too.",
    "",
    "Read about [services](/docs/concepts/net/service/) next.",
    "",
])

FILES = {
    "concepts/workloads/run-deployment.md": PAGE,
    "reference/glossary/pod.md": term_doc(
        "pod", ["core-object", "fundamental"],
        f"Groups {tip('container', 'containers')} and a {tip('sidecar')}.\n"
        "{{< note >}}Keep no state inside.{{< /note >}}"),
    "reference/glossary/deployment.md": term_doc(
        "deployment", ["workload", "fundamental"],
        f"Updates {tip('pod', 'Pods')} and {tip('replicaset', 'sets')}.\n\n## A heading here\n"),
    "reference/glossary/service.md": term_doc(
        "service", ["networking", "fundamental"], f"Finds {tip('pod', 'Pods')} by label."),
    "reference/glossary/ingress.md": term_doc(
        "ingress", ["networking"], f"Routes to {tip('service', 'Services')}; see "
        f"{tip('ingress-controller', 'controllers')}."),
    "reference/glossary/container.md": term_doc(
        "container", ["core-object"], f"The smallest piece of software; it runs inside {tip('pod', 'Pods')}."),
}


def ref(name):
    return {"$ref": f"#/definitions/{name}"}


APPS, CORE, BASE = "io.k8s.api.apps.v1.", "io.k8s.api.core.v1.", "io.k8s.apimachinery.pkg.apis.meta.v1."
TEXT = {"type": "string"}

SPEC = {
    "swagger": "2.0",
    "paths": {
        "/apis/apps/v1/namespaces/{namespace}/deployments": {
            "post": {"operationId": "makeDeployment", "description": "make one"},
            "get": {"operationId": "listDeployments", "description": "list them"},
            "parameters": [{"name": "pretty"}],
        },
        "/api/v1/namespaces/{namespace}/pods": {
            "post": {"operationId": "makePod"},
            "get": {},
        },
        "/api/v1/namespaces/{namespace}/services": {"post": {"operationId": "makeService"}},
    },
    "definitions": {
        APPS + "Deployment": {
            "description": "Keeps replicas running.",
            "properties": {"apiVersion": TEXT, "kind": TEXT, "metadata": ref(BASE + "ObjectMeta"),
                           "spec": ref(APPS + "DeploymentSpec"),
                           "status": ref(APPS + "DeploymentStatus")},
        },
        APPS + "DeploymentSpec": {
            "description": "What is wanted.",
            "properties": {"replicas": TEXT, "selector": ref(BASE + "LabelSelector"),
                           "template": ref(CORE + "PodTemplateSpec")},
        },
        CORE + "Pod": {
            "description": "Containers on one host.",
            "properties": {"kind": TEXT, "metadata": ref(BASE + "ObjectMeta"),
                           "spec": ref(CORE + "PodSpec")},
        },
        CORE + "Service": {"description": "A stable name.",
                           "properties": {"spec": ref(CORE + "ServiceSpec")}},
        CORE + "ServiceSpec": {"description": "Its ports.", "properties": {"ports": TEXT}},
        BASE + "ObjectMeta": {"description": "Names.", "properties": {"name": TEXT}},
        BASE + "LabelSelector": {"description": "Labels.", "properties": {"matchLabels": TEXT}},
        APPS + "DeploymentStatus": {"description": "What is seen."},
        CORE + "PodSpec": {"description": "Its containers."},
        CORE + "PodTemplateSpec": {"description": "A template."},
    },
}


def write_sample(root):
    for rel, text in FILES.items():
        path = os.path.join(root, "docs", rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    spec = os.path.join(root, "spec.json")
    with open(spec, "w", encoding="utf-8") as f:
        json.dump(SPEC, f)
    return os.path.join(root, "docs"), spec
