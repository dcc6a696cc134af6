"""Infrastructure rules over Dockerfile, Terraform and Kubernetes texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulint.operators.lines import Rule, scan

# Rules of single Dockerfile lines.
DOCKER_LINES = [
    Rule("HardcodedCredential", "Medium", 0.8, r"(?i)^#.*--build-arg.*(secret|password|token|key)", message="comment suggests secrets by build argument"),
    Rule("HardcodedCredential", "Critical", 0.9, r"(?i)^ENV\s+\S*(password|secret|token|api_?key|credential)\S*[= ]\s*\S+", message="secret in ENV"),
    Rule("HardcodedCredential", "High", 0.9, r"(?i)^ARG\s+\S*(password|secret|token|api_?key|credential)\w*\s*=\s*\S+", message="ARG with a secret as default"),
    Rule("HardcodedCredential", "High", 0.9, r"(?i)^(COPY|ADD)\s.*(\.env\b|credentials|id_rsa|\.pem\b|\.key\b)", message="sensitive file in the image"),
    Rule("EvalUsage", "Critical", 0.95, r"(?i)^RUN\s.*(curl|wget)[^|]*\|\s*(sudo\s+)?(ba|z|da)?sh\b", message="download piped to a shell"),
    Rule("ConventionViolation", "Low", 0.8, r"(?i)^RUN\s.*apt-get\s+install", unless="--no-install-recommends", message="apt-get without --no-install-recommends"),
    Rule("RunningAsRoot", "Medium", 0.8, r"(?i)^RUN\s.*\bsudo\b", message="sudo in RUN"),
    Rule("EvalUsage", "High", 0.9, r"(?i)^ADD\s+https?://", message="ADD from a remote address"),
    Rule("ConventionViolation", "Medium", 0.8, r"(?i)^ADD\s", unless=r"(?i)^ADD\s+https?://", message="ADD instead of COPY"),
    Rule("ConventionViolation", "Low", 0.8, r"(?i)^VOLUME\s", message="anonymous volume"),
    Rule("OpenSecurityGroup", "Medium", 0.8, r"(?i)^EXPOSE\s(.*\s)?22(/\w+)?(\s|$)", message="SSH port exposed"),
    Rule("ConventionViolation", "Low", 0.7, r"(?i)^RUN\s.*;", unless="&&", message="RUN chained by semicolons"),
]
# Rules of single Terraform lines.
TERRAFORM_LINES = [
    Rule("ConventionViolation", "Low", 0.9, r"(?i)(#|//)\s*(TODO|FIXME|HACK|XXX)\b", message="open task"),
    Rule("OpenSecurityGroup", "High", 0.9, r'protocol\s*=\s*"-1"', message="all protocols"),
    Rule("PublicResource", "Critical", 0.95, r'acl\s*=\s*"public-read(-write)?"', message="public bucket"),
    Rule("PublicResource", "Critical", 0.95, r"publicly_accessible\s*=\s*true", message="public database"),
    Rule("IamOverPermission", "Critical", 0.9, r'(?i)\bActions?\s*=\s*\[?\s*"\*"', message="any action"),
    Rule("IamOverPermission", "High", 0.85, r'(?i)\bResources?\s*=\s*\[?\s*"\*"', message="any resource"),
    Rule("HardcodedCredential", "Critical", 0.95, r'(?i)(access_key|aws_access_key_id)\s*=\s*"(AKIA|ASIA)[A-Z0-9]{16}"', message="access key"),
    Rule("HardcodedCredential", "Critical", 0.9, r'(?i)(password|secret_key|access_key|api_key|token|master_password|admin_password)\s*=\s*"[^"]{8,}"', message="credential"),
    Rule("ConventionViolation", "High", 0.9, r"force_destroy\s*=\s*true", message="force_destroy"),
]
# Fixed values: (resource types, flag that must be there, kind, severity, message).
TERRAFORM_BLOCKS = [
    (("aws_s3_bucket",), "encryption", "UnencryptedStorage", "High", "bucket without encryption"),
    (("aws_s3_bucket",), "versioning", "UnencryptedStorage", "Medium", "bucket without versioning"),
    (("aws_s3_bucket",), "logging", "Soc2Violation", "Medium", "bucket without logging"),
    (("aws_db_instance", "aws_rds_cluster"), "encryption", "UnencryptedStorage", "High", "database without encryption"),
    (("aws_ebs_volume",), "encryption", "UnencryptedStorage", "Medium", "volume without encryption"),
    (("aws_security_group",), "egress", "OpenSecurityGroup", "Medium", "no egress rule"),
    (("aws_instance",), "imdsv2", "Soc2Violation", "Medium", "metadata service without tokens"),
    (("aws_lambda_function",), "vpc", "NoNetworkPolicy", "Medium", "function outside a network"),
    (("aws_autoscaling_group",), "health", "MissingHealthProbes", "Medium", "no health check"),
    (("aws_vpc",), "flow", "NoNetworkPolicy", "Medium", "no flow log"),
]
FLAGS = {
    "encryption": "server_side_encryption|encrypted.*true", "versioning": r"versioning.*\{", "logging": r"logging.*\{", "egress": r"egress\s*\{", "imdsv2": r'http_tokens\s*=\s*"required"',
    "vpc": "vpc_config|subnet_ids", "health": "health_check", "flow": "flow_log", "inline": "inline_policy", "tags": r"tags.*[{=]", "open": r'(cidr_blocks|cidr)\s*=\s*\[?\s*"0\.0\.0\.0/0"|(ipv6_cidr_blocks|ipv6_cidr)\s*=\s*\[?\s*"::/0"', "ingress": r"ingress\s*\{",
}


def _out(rows: DataFrame, ln: str | Column = "ln") -> DataFrame:
    return rows.select("path", F.col(ln).alias("ln") if isinstance(ln, str) else ln.alias("ln"), "kind", "severity", "message")


def logical_lines(lines: DataFrame) -> DataFrame:
    """(path, ln, line) with continued lines joined under their first number."""
    w = W.partitionBy("path").orderBy("ln")
    goes_on = F.col("line").rlike(r"\\\s*$")
    first = F.coalesce(~F.lag(goes_on).over(w), F.lit(True))
    rows = lines.withColumn("__k", F.sum(first.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    body = rows.groupBy("path", "__k").agg(F.min("ln").alias("ln"), F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("b"))
    return body.select("path", "ln", F.trim(F.array_join(F.transform("b", lambda x: F.regexp_replace(x["line"], r"\\\s*$", "")), " ")).alias("line"))


def dockerfile(lines: DataFrame) -> DataFrame:
    """(path, ln, kind, severity, message) of Dockerfile lines (path, ln, line)."""
    rows = logical_lines(lines)
    stage = F.regexp_extract("line", r"(?i)^FROM\s+(?:--\S+\s+)*(\S+)(?:\s+AS\s+(\S+))?", 1)
    alias = F.regexp_extract("line", r"(?i)^FROM\s+.*\sAS\s+(\S+)", 1)
    before = W.partitionBy("path").orderBy("ln").rowsBetween(W.unboundedPreceding, -1)
    image = rows.withColumn("image", stage).withColumn("earlier", F.collect_set(F.when(alias != "", F.lower(alias))).over(before)).filter("image <> '' and image <> 'scratch'")
    image = image.filter(~F.array_contains("earlier", F.lower("image")) & ~F.col("image").contains("@sha256:"))
    loose = ~F.col("image").contains(":") | F.col("image").endswith(":latest")
    pins = image.select("path", "ln", F.lit("UnpinnedImage").alias("kind"), F.when(loose, "High").otherwise("Medium").alias("severity"), F.when(loose, "image without a version").otherwise("image without a digest").alias("message"))
    upper = F.upper(F.regexp_extract("line", r"^([A-Za-z]+)\s", 1))
    user = F.regexp_extract("line", r"(?i)^USER\s+(\S+)", 1)
    per = rows.withColumn("op", upper).groupBy("path").agg(
        F.max_by(F.when(user != "", user), F.when(user != "", F.col("ln"))).alias("user"), F.max(F.when(user != "", F.col("ln"))).alias("user_ln"),
        *[F.count_if(F.col("op") == o).alias(o) for o in ("HEALTHCHECK", "CMD", "ENTRYPOINT", "LABEL", "FROM")],
    )
    whole = F.array(
        F.when(F.col("user").isNull(), F.struct(F.lit(1).alias("ln"), F.lit("RunningAsRoot").alias("kind"), F.lit("High").alias("severity"), F.lit("no USER").alias("message"))),
        F.when(F.col("user").isin("root", "0"), F.struct(F.col("user_ln").alias("ln"), F.lit("RunningAsRoot").alias("kind"), F.lit("Critical").alias("severity"), F.lit("runs as root").alias("message"))),
        F.when(F.col("HEALTHCHECK") == 0, F.struct(F.lit(1).alias("ln"), F.lit("MissingHealthProbes").alias("kind"), F.lit("Low").alias("severity"), F.lit("no HEALTHCHECK").alias("message"))),
        F.when(F.col("CMD") > 1, F.struct(F.lit(1).alias("ln"), F.lit("ConventionViolation").alias("kind"), F.lit("Low").alias("severity"), F.lit("several CMD").alias("message"))),
        F.when(F.col("ENTRYPOINT") > 1, F.struct(F.lit(1).alias("ln"), F.lit("ConventionViolation").alias("kind"), F.lit("Low").alias("severity"), F.lit("several ENTRYPOINT").alias("message"))),
        F.when(F.col("LABEL") == 0, F.struct(F.lit(1).alias("ln"), F.lit("ConventionViolation").alias("kind"), F.lit("Low").alias("severity"), F.lit("no LABEL").alias("message"))),
    )
    missing = per.filter(F.col("FROM") > 0).select("path", F.explode(F.filter(whole, lambda x: x.isNotNull())).alias("m")).select("path", "m.*")
    return _out(scan(rows, DOCKER_LINES)).unionByName(_out(pins)).unionByName(_out(missing))


def terraform(lines: DataFrame) -> DataFrame:
    """(path, ln, kind, severity, message) of Terraform lines.  Resources are blocks
    by the running depth of braces; what a block lacks is a flag that no line of it
    sets, so one aggregation settles all such rules."""
    w = W.partitionBy("path").orderBy("ln")
    change = F.regexp_count("line", F.lit(r"\{")) - F.regexp_count("line", F.lit(r"\}"))
    rows = lines.withColumn("after", F.sum(change).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("depth", F.col("after") - change)
    top = (F.col("depth") == 0) & F.col("line").rlike(r"^(resource|variable|terraform|data|module|provider|output|locals)\b")
    rows = rows.withColumn("block", F.sum(top.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).filter("block > 0")
    blocks = rows.groupBy("path", "block").agg(
        F.min("ln").alias("ln"), F.min_by("line", "ln").alias("head"), *[F.max(F.col("line").rlike(p)).alias(f"has_{k}") for k, p in FLAGS.items()],
        F.max(F.col("line").rlike(r"from_port\s*=\s*0\b")).alias("port0"), F.max(F.col("line").rlike(r"to_port\s*=\s*(0|65535)\b")).alias("port1"),
        F.max(F.col("line").rlike(r'(?i)default\s*=\s*"[^"]{8,}"')).alias("default"), F.max(F.col("line").rlike(r"required_version\s*=")).alias("version"), F.max(F.col("line").rlike(r"^\s*backend\s+\"")).alias("backend"),
    )
    kind_of = F.regexp_extract("head", r'^resource\s+"([^"]+)"', 1)
    variable = F.regexp_extract("head", r'^variable\s+"([^"]+)"', 1)
    fits = lambda k, s, m: F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.lit(m).alias("message"))
    found = [F.when(F.col("type").isin(*types) & ~F.col(f"has_{flag}"), fits(k, s, m)) for types, flag, k, s, m in TERRAFORM_BLOCKS]
    found += [
        F.when((F.col("type") == "aws_security_group") & F.col("has_ingress") & F.col("has_open"), fits("OpenSecurityGroup", "Critical", "open to the world")),
        F.when(F.col("has_ingress") & F.col("port0") & F.col("port1"), fits("OpenSecurityGroup", "Critical", "all ports")),
        F.when((F.col("type") == "aws_iam_user") & F.col("has_inline"), fits("IamOverPermission", "Medium", "inline policy of a user")),
        F.when(F.col("type").startswith("aws_") & ~F.col("has_tags") & F.col("type").isin("aws_instance", "aws_s3_bucket", "aws_db_instance", "aws_vpc", "aws_ebs_volume", "aws_lambda_function"), fits("ConventionViolation", "Low", "no tags")),
        F.when(F.col("variable").rlike("(?i)password|secret|token|api_key|credential") & F.col("default"), fits("HardcodedCredential", "High", "sensitive default")),
        F.when(F.col("head").rlike(r"^terraform\b") & ~F.col("version"), fits("UnpinnedImage", "Low", "no required version")),
        F.when(F.col("head").rlike(r"^terraform\b") & ~F.col("backend"), fits("Soc2Violation", "High", "no backend")),
    ]
    lacking = blocks.withColumn("type", kind_of).withColumn("variable", variable).select("path", "ln", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("m")).select("path", "ln", "m.*")
    return _out(scan(lines, TERRAFORM_LINES)).unionByName(_out(lacking))


def _containers(doc: dict) -> tuple[dict, list[dict]]:
    spec = doc.get("spec") or {}
    kind = doc.get("kind")
    if kind == "CronJob":
        spec = ((spec.get("jobTemplate") or {}).get("spec") or {}).get("template", {}).get("spec") or {}
    elif kind != "Pod":
        spec = (spec.get("template") or {}).get("spec") or {}
    return spec, [c for k in ("initContainers", "containers") for c in spec.get(k) or [] if isinstance(c, dict)]


def _workload(doc: dict) -> list[tuple[str, str, str]]:
    """(kind, severity, message) of one manifest."""
    import re

    out, kind = [], doc.get("kind")
    spec, containers = _containers(doc) if kind in ("Pod", "Deployment", "StatefulSet", "DaemonSet", "Job", "CronJob", "ReplicaSet") else ({}, [])
    for key, severity in (("hostNetwork", "High"), ("hostPID", "High"), ("hostIPC", "High")):
        if spec.get(key) is True:
            out.append(("PrivilegedContainer", severity, key))
    for c in containers:
        s, image = c.get("securityContext") or {}, str(c.get("image") or "")
        caps = [str(x).upper() for x in ((s.get("capabilities") or {}).get("drop") or [])]
        checks = [
            (s.get("privileged") is True, "PrivilegedContainer", "Critical", "privileged"),
            (s.get("runAsUser") == 0, "RunningAsRoot", "High", "user 0"),
            (s.get("runAsNonRoot") is not True, "RunningAsRoot", "Medium", "runAsNonRoot is not set"),
            (s.get("readOnlyRootFilesystem") is not True, "PrivilegedContainer", "Medium", "root file system is writable"),
            (s.get("allowPrivilegeEscalation") is not False, "PrivilegedContainer", "Medium", "privilege escalation"),
            ("ALL" not in caps, "PrivilegedContainer", "Medium", "capabilities are kept"),
            (not (c.get("resources") or {}).get("limits"), "MissingResourceLimits", "Medium", "no limits"),
            (not (c.get("resources") or {}).get("requests"), "MissingResourceLimits", "Low", "no requests"),
            (not c.get("livenessProbe"), "MissingHealthProbes", "Medium", "no liveness probe"),
            (not c.get("readinessProbe"), "MissingHealthProbes", "Medium", "no readiness probe"),
            (image.endswith(":latest"), "UnpinnedImage", "Medium", "latest image"),
            (bool(image) and ":" not in image.split("/")[-1] and "@" not in image, "UnpinnedImage", "Medium", "image without a tag"),
            (re.search(r":v?0\.\d+\.\d+", image) is not None, "UnpinnedImage", "Low", "pre-release image"),
        ]
        out += [x[1:] for x in checks if x[0]]
        for e in c.get("env") or []:
            name, value = str(e.get("name") or ""), str(e.get("value") or "")
            if re.search("(?i)password|secret|api_key|token|credential|private_key", name) and value and not e.get("valueFrom"):
                out.append(("SecretInEnvVar", "Critical", name))
            if name.lower() in ("ssl_enabled", "tls_enabled", "tls_verify", "ssl_verify") and value.lower() in ("false", "0", "no", "off"):
                out.append(("Soc2Violation", "High", name))
    spec = doc.get("spec") or {}
    if kind == "Ingress" and not spec.get("tls"):
        out.append(("Soc2Violation", "Medium", "ingress without TLS"))
    if kind == "NetworkPolicy":
        if not (spec.get("podSelector") or {}).get("matchLabels") and not spec.get("policyTypes"):
            out.append(("NoNetworkPolicy", "High", "policy without effect"))
        if '0.0.0.0/0' in str(spec):
            out.append(("OpenSecurityGroup", "Critical", "open address range"))
    if kind in ("Role", "ClusterRole"):
        for rule in doc.get("rules") or []:
            if "*" in [*(rule.get("apiGroups") or []), *(rule.get("resources") or []), *(rule.get("verbs") or [])]:
                out.append(("IamOverPermission", "High", "wildcard in a role"))
    if kind == "ServiceAccount" and doc.get("automountServiceAccountToken") is not False:
        out.append(("IamOverPermission", "Low", "token is mounted"))
    if kind == "Secret" and (doc.get("stringData") or doc.get("data")):
        out.append(("HardcodedCredential", "High", "secret in a manifest"))
    return out


def kubernetes(documents: DataFrame) -> DataFrame:
    """(path, ln, kind, severity, message) of manifests (path, first_ln, text).  A
    document that cannot be read gives a ParseFailure and stops nothing."""
    import pandas as pd

    def run(parts):
        import yaml

        for p in parts:
            rows = []
            for path, ln, text in zip(p["path"], p["first_ln"], p["text"]):
                try:
                    doc = yaml.safe_load(text)
                    rows += [(path, ln, *x) for x in (_workload(doc) if isinstance(doc, dict) else [])]
                except Exception:
                    rows.append((path, ln, "ParseFailure", "Info", "manifest cannot be read"))
            yield pd.DataFrame(rows, columns=["path", "ln", "kind", "severity", "message"]).astype({"ln": "int32"})

    return documents.select("path", F.col("first_ln").cast("int").alias("first_ln"), "text").mapInPandas(run, "path string, ln int, kind string, severity string, message string")
