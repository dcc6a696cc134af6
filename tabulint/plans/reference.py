"""What each finding kind means: a small dimension table with lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# kind, category, why it matters, what to do
KINDS = (
    ("SqlInjection", "security", "input becomes part of a query", "bind the value as a parameter"),
    ("XssVulnerability", "security", "input becomes part of a page", "escape it for the place it goes to"),
    ("PathTraversal", "security", "input chooses a file", "resolve the path and check its root"),
    ("EvalUsage", "security", "text is run as code", "parse the data instead"),
    ("WeakCrypto", "security", "the hash can be forged", "use a current hash or a password hash"),
    ("HardcodedSecret", "security", "the secret is in the history of the code", "rotate it and read it at run time"),
    ("NonConstantTimeComparison", "security", "the time taken tells how much agrees", "compare in constant time"),
    ("StaticAeadNonce", "security", "a nonce used twice breaks the cipher", "draw a fresh one for each message"),
    ("UnvalidatedLengthPrefix", "security", "a peer chooses how much is allocated", "check the length against a limit"),
    ("MissingAuthMiddleware", "security", "anyone can call the route", "put it behind authentication"),
    ("VulnerableDependency", "dependencies", "a known flaw is fixed in a later version", "update the package"),
    ("UnmaintainedDependency", "dependencies", "nobody fixes it any more", "replace the package"),
    ("DuplicateDependency", "dependencies", "several versions are built in", "agree on one version"),
    ("DeadFunction", "architecture", "nothing uses it", "delete it"),
    ("ExactDuplicate", "architecture", "the same text stands in several places", "keep one and call it"),
    ("RenamedDuplicate", "architecture", "the same code under other names", "keep one and call it"),
    ("SemanticDuplicate", "architecture", "the same structure again", "see whether one can serve all"),
    ("SplitDatagramMessage", "architecture", "a lost piece tears the message", "send a message in one write"),
    ("OversizedDatagram", "architecture", "a lost fragment loses the whole", "keep a datagram under the packet size"),
    ("GodClass", "complexity", "one class does too much", "split it by task"),
    ("LongFunction", "complexity", "hard to read and test", "split it"),
    ("TooManyParams", "complexity", "calls are easy to get wrong", "group the parameters"),
    ("ConventionViolation", "naming", "names do not follow the convention", "rename it"),
    ("NamingInconsistency", "naming", "several words for one thing", "choose one"),
    ("NPlusOneQuery", "performance", "a query per row", "load the relation at once"),
    ("MissingHookDependencies", "performance", "the hook runs on every render", "list what it depends on"),
    ("BlockingInAsync", "performance", "all tasks of the thread wait", "use the asynchronous call"),
    ("LockAcrossAwait", "performance", "the lock is held while the task sleeps", "drop it before the await"),
    ("LockOnHotPath", "performance", "callers wait for each other", "share less or shard"),
    ("UnboundedChannel", "performance", "the queue grows without end", "give it a bound"),
    ("HotPathAllocation", "performance", "memory is taken for each message", "reuse a buffer"),
    ("PanicRisk", "reliability", "the process ends", "handle the error"),
    ("UnsafeUsage", "reliability", "the compiler does not check it", "explain or avoid it"),
    ("MissingSafetyComment", "reliability", "nobody can tell why it is sound", "write down the reason"),
    ("OpenSecurityGroup", "infrastructure", "the world can connect", "narrow the range"),
    ("UnencryptedStorage", "infrastructure", "data lies in the clear or unversioned", "turn it on"),
    ("PublicResource", "infrastructure", "anyone can read it", "make it private"),
    ("IamOverPermission", "infrastructure", "more rights than needed", "list actions and resources"),
    ("RunningAsRoot", "infrastructure", "a break-out has all rights", "set another user"),
    ("PrivilegedContainer", "infrastructure", "the container reaches the host", "drop the privilege"),
    ("MissingResourceLimits", "infrastructure", "one container can starve the rest", "set limits"),
    ("MissingHealthProbes", "infrastructure", "nobody notices that it hangs", "add a probe"),
    ("UnpinnedImage", "infrastructure", "a build can change by itself", "pin the version"),
    ("NoNetworkPolicy", "infrastructure", "traffic is not limited", "add a policy"),
    ("SecretInEnvVar", "infrastructure", "the secret stands in the manifest", "refer to a secret store"),
    ("HardcodedCredential", "infrastructure", "the credential stands in the file", "refer to a secret store"),
    ("Soc2Violation", "compliance", "a control is missing", "turn it on"),
    ("DangerousChain", "security", "an entry point leads to a dangerous call", "check what is on the way"),
    ("ParseFailure", "diagnostic", "the file was not analysed", "look at the file"),
    ("StaleSuppression", "diagnostic", "the comment suppresses nothing", "delete it"),
    ("CrateApiMisuse", "reliability", "the library is used against its rules", "follow its documentation"),
)


def table(spark: SparkSession) -> DataFrame:
    """(kind, category, why, fix, alias): alias is the kind in kebab case."""
    rows = spark.createDataFrame(KINDS, "kind string, category string, why string, fix string")
    return rows.withColumn("alias", F.lower(F.regexp_replace("kind", "(?<=[a-z0-9])(?=[A-Z])", "-")))


def lookup(reference: DataFrame, name: str) -> DataFrame:
    """The kind of a name, whatever its case and separators."""
    key = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    return reference.filter(key(F.col("kind")) == key(F.lit(name)))


def suggestions(reference: DataFrame, name: str, most: int = 3) -> DataFrame:
    """The kinds nearest to a misspelt name, by edit distance."""
    return reference.withColumn("distance", F.levenshtein(F.lower("kind"), F.lit(name.lower()))).orderBy("distance", "kind").limit(most)


def explained(findings: DataFrame, reference: DataFrame) -> DataFrame:
    """findings with why and fix; the dimension has a row a kind."""
    return findings.join(reference.select("kind", "category", "why", "fix"), "kind", "left")
