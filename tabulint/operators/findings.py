"""The finding algebra: order, dedup, fingerprints, scores, triage, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulint.functions.scalar import fnv1a64, is_auxiliary, slashes, without_digits

SEVERITIES = ("Critical", "High", "Medium", "Low", "Info")

# Kinds by the score dimension they count for, and points by severity
# (Critical, High, Medium, Low, Info).
PENALTIES: dict[str, list[tuple[tuple[str, ...], tuple[int, int, int, int, int]]]] = {
    "security": [
        (("SqlInjection", "XssVulnerability", "WeakCrypto", "HardcodedSecret", "EvalUsage", "WeakRandom", "PathTraversal", "OpenRedirect", "NonConstantTimeComparison", "StaticAeadNonce"), (15, 5, 2, 1, 1)),
        (("MissingAuthMiddleware", "MissingRoleCheck", "UnvalidatedLengthPrefix"), (15, 5, 2, 2, 2)),
        (("VulnerableDependency",), (15, 8, 4, 2, 2)),
    ],
    "architecture": [
        (("SplitDatagramMessage", "OversizedDatagram"), (15, 8, 4, 2, 2)),
        (("UnmaintainedDependency",), (2, 2, 2, 2, 2)),
        (("DuplicateDependency",), (1, 1, 1, 1, 1)),
    ],
    "performance": [
        (("NPlusOneQuery",), (1, 10, 5, 2, 1)),
        (("StringConcatInLoop", "ObjectInstantiationInLoop"), (3, 3, 3, 3, 3)),
        (("MissingHookDependencies",), (2, 2, 2, 2, 2)),
    ],
    "infrastructure": [
        (
            ("OpenSecurityGroup", "UnencryptedStorage", "PublicResource", "IamOverPermission", "RunningAsRoot", "PrivilegedContainer", "MissingResourceLimits", "MissingHealthProbes", "UnpinnedImage", "NoNetworkPolicy", "SecretInEnvVar", "HardcodedCredential"),
            (15, 8, 4, 2, 1),
        ),
    ],
}
#: Kinds whose density over the symbols is scored: (dimension, kinds, most points).
DENSITIES = (
    ("architecture", ("DeadFunction", "DeadClass", "DeadFile"), 50),
    ("architecture", ("ExactDuplicate", "RenamedDuplicate", "SemanticDuplicate"), 30),
    ("naming", ("ConventionViolation", "NamingInconsistency"), 40),
    ("complexity", ("LongFunction", "TooManyParams", "HighComplexity", "DeepNesting"), 50),
)
WEIGHTS = {"security": 0.25, "architecture": 0.15, "performance": 0.10, "naming": 0.08, "complexity": 0.10, "infrastructure": 0.12}
#: Kinds that inform and never cap the overall score.
INFORMATIONAL = ("UnsafeUsage", "PanicRisk", "BlockingInAsync", "UnboundedChannel", "HotPathAllocation", "LockOnHotPath", "DangerousChain", "MissingSafetyComment", "ParseFailure", "StaleSuppression")
#: Kinds that are reported in auxiliary files too.
EVERYWHERE = (
    "OpenSecurityGroup", "UnencryptedStorage", "PublicResource", "IamOverPermission", "RunningAsRoot", "PrivilegedContainer", "MissingResourceLimits", "MissingHealthProbes",
    "UnpinnedImage", "NoNetworkPolicy", "SecretInEnvVar", "HardcodedCredential", "PciViolation", "GdprViolation", "Soc2Violation", "ParseFailure", "StaleSuppression",
)
LEAST_SYMBOLS, SATURATION = 100, 0.10


def severity_rank(severity: Column) -> Column:
    """4 for Critical down to 0 for Info."""
    return F.coalesce(*[F.when(severity == s, F.lit(len(SEVERITIES) - 1 - i)) for i, s in enumerate(SEVERITIES)], F.lit(-1))


def shipped(findings: DataFrame, file: str = "file") -> DataFrame:
    """Findings outside auxiliary files, and those of kinds reported everywhere."""
    return findings.filter(~is_auxiliary(F.col(file)) | F.col("kind").isin(*EVERYWHERE))


def first_wins(findings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first finding of each key in the given total order."""
    return findings.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def fingerprints(findings: DataFrame, order: list[str], hashed=fnv1a64, file: str = "file", symbol: str = "symbol") -> DataFrame:
    """findings with fingerprint: a hash of kind, path, symbol, the message without
    digits, and the finding's number among those that agree in all that."""
    material = F.concat_ws("|", F.col("kind"), slashes(F.col(file)), F.coalesce(F.col(symbol), F.lit("")), without_digits(F.col("message")))
    numbered = findings.withColumn("__m", material).withColumn("__k", F.row_number().over(W.partitionBy("__m").orderBy(*order)) - 1)
    return numbered.withColumn("fingerprint", hashed(F.concat_ws("|", F.col("__m"), F.col("__k").cast("string")))).drop("__m", "__k")


def density_points(count: Column, symbols: Column, most: int) -> Column:
    return F.round(F.least(count / F.greatest(symbols, F.lit(LEAST_SYMBOLS)) / SATURATION * most, F.lit(float(most)))).cast("int")


def score(findings: DataFrame, symbols: Column | int, test_score: Column | int = 0) -> DataFrame:
    """One row: each dimension from 100 down to 0, and overall, the truncated
    weighted mean, at most 79 with a Critical finding that is not informational
    and 89 with a High one.  One aggregation over the findings."""
    aggs = []
    for dimension, rules in PENALTIES.items():
        points = F.lit(0)
        for kinds, by in rules:
            value = F.coalesce(*[F.when(F.col("severity") == s, F.lit(p)) for s, p in zip(SEVERITIES, by)], F.lit(by[-1]))
            points = points + F.when(F.col("kind").isin(*kinds), value).otherwise(0)
        aggs.append(F.coalesce(F.sum(points), F.lit(0)).alias(f"p_{dimension}"))
    for i, (_, kinds, _) in enumerate(DENSITIES):
        aggs.append(F.count_if(F.col("kind").isin(*kinds)).alias(f"d_{i}"))
    real = ~F.col("kind").isin(*INFORMATIONAL)
    aggs += [F.count_if(real & (F.col("severity") == s)).alias(f"n_{s}") for s in ("Critical", "High")]
    row = findings.agg(*aggs)
    n = symbols if isinstance(symbols, Column) else F.lit(symbols)
    out = {}
    for dimension in WEIGHTS:
        total = F.col(f"p_{dimension}") if dimension in PENALTIES else F.lit(0)
        for i, (d, _, most) in enumerate(DENSITIES):
            if d == dimension:
                total = total + density_points(F.col(f"d_{i}"), n, most)
        out[dimension] = F.greatest(F.lit(0), 100 - total).cast("int")
    whole = sum(WEIGHTS.values())
    row = row.select("*", *[c.alias(d) for d, c in out.items()])
    mean = sum((F.col(d) * w for d, w in WEIGHTS.items()), F.lit(0.0)) / whole
    cap = F.when(F.col("n_Critical") > 0, 79).when(F.col("n_High") > 0, 89).otherwise(100)
    test = test_score if isinstance(test_score, Column) else F.lit(test_score)
    return row.select(*WEIGHTS, test.cast("int").alias("test_coverage"), F.least(F.floor(F.round(mean, 6)), cap).cast("int").alias("overall"))


def test_dimension(reach: DataFrame, roots: bool = True, full: float = 35.0) -> int:
    """The score of tests from (functions, reached) by file: the share that tests reach,
    of which `full` percent are as good as all; 0 without tests."""
    if not roots:
        return 0
    n = reach.agg(F.sum("functions").alias("f"), F.sum("reached").alias("r")).first()
    share = 100.0 * (n["r"] or 0) / n["f"] if n["f"] else 0.0
    return int(min(share / full, 1.0) * 100 + 0.5)


def triage(findings: DataFrame) -> DataFrame:
    """findings with route: auto_fix, ai_review or human."""
    return findings.withColumn("route", F.when(F.col("auto_fixable") & (F.col("confidence") >= 0.85), "auto_fix").when(F.col("confidence") >= 0.5, "ai_review").otherwise("human"))


def deploy_gate(scores: DataFrame, findings: DataFrame, files: int, least_overall: int = 85, least_security: int = 90, most_critical: int = 0) -> DataFrame:
    """One row (passed, overall, security, critical); no files at all never pass."""
    bad = findings.agg(F.count_if((F.col("severity") == "Critical") & (F.col("kind") != "DangerousChain")).alias("critical"))
    both = scores.select("overall", "security").join(F.broadcast(bad))
    ok = (F.col("overall") >= least_overall) & (F.col("security") >= least_security) & (F.col("critical") <= most_critical)
    return both.select((ok & F.lit(files > 0)).alias("passed"), "overall", "security", "critical")


def verdict(findings: DataFrame, threshold: str = "High") -> DataFrame:
    """Findings of a verdict, worst first: no Info and no chains; `fails` marks
    those at the threshold or above."""
    out = findings.filter((F.col("severity") != "Info") & (F.col("kind") != "DangerousChain"))
    least = len(SEVERITIES) - 1 - SEVERITIES.index(threshold)
    return out.withColumn("fails", severity_rank(F.col("severity")) >= least).orderBy(severity_rank(F.col("severity")).desc(), "file", "line", "kind", "message")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))
