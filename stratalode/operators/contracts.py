"""Matching of declared client and server bindings over contracts, with the first reason that speaks against a match.

A null service, route or topic is one that is computed at run time, '' one that is
missing; the two stay apart.  Only client and producer bindings originate rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import salted_join

ORIGINS = ("client", "producer")
# What identifies a contract, by protocol, and the reasons in the order in which the first that applies is given.
IDENTITY = {
    "http": ("contract_service_id", "namespace", "protocol", "method", "path", "operation", "operation_ref", "request_schema", "response_schema"),
    "rpc": ("contract_service_id", "namespace", "protocol", "rpc_service", "operation", "request_schema", "response_schema"),
    "queue": ("contract_service_id", "namespace", "protocol", "topic", "schema"),
}
FIELDS = tuple(dict.fromkeys(f for fields in IDENTITY.values() for f in fields))
REASONS = (
    "origin_source_affinity_unqualified", "computed_service", "missing_service", "computed_route", "missing_route", "computed_topic", "missing_contract", "missing_artifact_source",
    "unqualified_generated_claim", "stale_artifact", "rpc_service_and_operation_not_matched", "missing_operation", "schema_mismatch", "namespace_mismatch", "binding_contract_identity_mismatch",
    "stale_artifact_digest", "artifact_source_affinity_unqualified", "missing_server_binding", "missing_consumer_binding", "duplicate_endpoint_bindings",
)


def identity(prefix: str = "") -> Column:
    """The fields that identify a contract of the row's protocol as one text; null for another protocol.  Null fields are told from empty ones."""
    text = lambda f: F.coalesce(F.concat(F.lit("="), F.col(prefix + f)), F.lit("-"))
    out = F.lit(None).cast("string")
    for protocol, fields in IDENTITY.items():
        out = F.when(F.col(prefix + "protocol") == protocol, F.concat_ws("\x1f", *[text(f) for f in fields])).otherwise(out)
    return out


def invalid(contracts: DataFrame, most: int = 1024) -> DataFrame:
    """``id, reason`` of declared identities that are not finite: another protocol, a field the protocol lacks, one that is empty or longer than ``most`` bytes."""
    known = F.col("protocol").isin(*IDENTITY)
    foreign, empty, long = F.lit(False), F.lit(False), F.lit(False)
    for f in FIELDS:
        has = F.col("protocol").isin(*[p for p, fields in IDENTITY.items() if f in fields])
        foreign = foreign | (~has & F.col(f).isNotNull())
        empty = empty | (has & (F.coalesce(F.col(f), F.lit("")) == ""))
        long = long | (F.coalesce(F.octet_length(F.col(f)), F.lit(0)) > most)
    reason = F.when(~F.coalesce(known, F.lit(False)), "unknown_protocol").when(foreign, "foreign_field").when(long, "field_too_long").when(empty, "incomplete_identity")
    return contracts.select("id", reason.alias("reason")).where("reason is not null")


def endpoints(bindings: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``id, declaration_id, endpoint_reason``: whether the declaration that a binding names is in the collection, unchanged and unique.

    ``bindings``: id, path, start_byte, end_byte, name, sha256; ``files``: path, status,
    sha256; ``symbols``: id, path, start_byte, end_byte, name, callable.
    """
    f = files.select("path", F.col("status").alias("_status"), F.col("sha256").alias("_sha")).dropDuplicates(["path"])
    per = symbols.where("callable").groupBy("path", "start_byte", "end_byte", "name").agg(F.count("*").alias("_n"), F.min("id").alias("_id"))
    j = bindings.join(f, "path", "left").join(per, ["path", "start_byte", "end_byte", "name"], "left")
    reason = (
        F.when(F.col("_sha").isNull() & F.col("_status").isNull(), "missing_binding_source").when(F.col("_status") == "partial_parse", "partial_or_stale_endpoint_source")
        .when(~F.col("_sha").eqNullSafe(F.col("sha256")), "stale_binding_source_digest").when(F.coalesce("_status", F.lit("")) != "parsed", "binding_source_affinity_unqualified")
        .when(F.coalesce("_n", F.lit(0)) != 1, "missing_or_ambiguous_endpoint_declaration")
    )
    return j.select(F.col("id"), F.when(reason.isNull(), F.col("_id")).alias("declaration_id"), reason.alias("endpoint_reason"))


def slices(witnesses: DataFrame, files: DataFrame) -> DataFrame:
    """``id, start_line, end_line, slice_sha256, reason`` of witnessed byte ranges of captured files.

    ``witnesses``: id, path, start_byte, end_byte, source_sha256, slice_sha256;
    ``files``: path, sha256, content (binary).  A file that changed, a range beyond it
    or other bytes in the range speak against a witness.
    """
    j = witnesses.join(files.select("path", F.col("sha256").alias("_sha"), "content"), "path", "left")
    length = F.col("end_byte") - F.col("start_byte")
    part = F.expr("substring(content, cast(start_byte as int) + 1, cast(end_byte - start_byte as int))")
    lines = lambda b: F.length(b.cast("string")) - F.length(F.replace(b.cast("string"), F.lit("\n"), F.lit("")))
    before = F.expr("substring(content, 1, cast(start_byte as int))")
    start = lines(before) + 1
    end = start + lines(part) - F.when(F.col("_last") == "\n", 1).otherwise(0)
    j = j.withColumn("_last", F.expr("cast(substring(content, cast(end_byte as int), 1) as string)")).withColumn("_slice", F.sha2(part, 256))
    reason = F.when(F.col("_sha").isNull(), "missing_source").when(~F.col("_sha").eqNullSafe(F.col("source_sha256")), "stale_source_digest").when((length <= 0) | (F.col("end_byte") > F.octet_length("content")), "range_outside_source").when(F.col("_slice") != F.col("slice_sha256"), "slice_differs")
    ok = reason.isNull()
    return j.select("id", F.when(ok, start).cast("int").alias("start_line"), F.when(ok, end).cast("int").alias("end_line"), F.when(ok, F.col("_slice")).alias("slice_sha256"), reason.alias("reason"))


def matches(bindings: DataFrame, contracts: DataFrame) -> DataFrame:
    """``binding_id, target_binding_id, certainty, reason``.

    ``bindings``: id, service_id, role, contract_id, the identity fields (``FIELDS``),
    endpoint_reason (of ``endpoints``, null if qualified), claimed_generated boolean,
    expected_sha256; ``contracts``: id, the identity fields, artifact_sha256 (null: not
    in the collection), contract_reason (null if its artifact is unchanged).
    Contracts and endpoints are reduced to one row per key before each join; a contract
    that a third of all bindings name is spread by salt.
    """
    b = bindings.withColumn("_identity", identity())
    c = contracts.select(F.col("id").alias("contract_id"), identity().alias("_c"), "artifact_sha256", "contract_reason", F.lit(True).alias("_has"), *[F.col(f).alias(f"_c_{f}") for f in ("operation", "request_schema", "response_schema", "schema", "namespace")]).dropDuplicates(["contract_id"])
    known = contracts.where("operation is not null").select(F.col("operation")).distinct().withColumn("_known", F.lit(True))
    role = F.when(F.col("role") == "server", "client").when(F.col("role") == "consumer", "producer")
    # for anything but queues the server must be the contract's owner
    ends = b.where((F.col("role") == "consumer") | ((F.col("role") == "server") & F.col("service_id").eqNullSafe(F.col("contract_service_id"))))
    bad = F.when(F.col("claimed_generated"), "unqualified_generated_claim")
    per = ends.groupBy(role.alias("role"), "contract_id", "_identity").agg(F.count("*").alias("_n"), F.min("id").alias("_e"), F.min("endpoint_reason").alias("_why"), F.min(bad).alias("_bad"), F.min("expected_sha256").alias("_expected"))
    j = salted_join(b.where(F.col("role").isin(*ORIGINS)), c, ["contract_id"], F.col("id"), "left")
    j = j.join(per, ["role", "contract_id", "_identity"], "left").join(known, "operation", "left")
    http, rpc, queue = (F.col("protocol") == p for p in ("http", "rpc", "queue"))
    def differs(*fields):
        out = F.lit(False)
        for f in fields:
            out = out | ~F.col(f).eqNullSafe(F.col(f"_c_{f}"))
        return out

    other = ~F.col("_identity").eqNullSafe(F.col("_c"))
    stale = lambda claimed, expected: F.when(claimed, "unqualified_generated_claim").when(expected.isNotNull() & (expected != F.col("artifact_sha256")), "stale_artifact")
    reason = (
        F.when(F.col("endpoint_reason").isNotNull(), "origin_source_affinity_unqualified")
        .when(F.col("contract_service_id").isNull(), "computed_service").when(F.col("contract_service_id") == "", "missing_service")
        .when(http & F.col("path").isNull(), "computed_route").when(http & (F.col("path") == ""), "missing_route").when(queue & F.col("topic").isNull(), "computed_topic")
        .when(F.col("_has").isNull(), "missing_contract").when(F.col("artifact_sha256").isNull(), "missing_artifact_source")
        .when(stale(F.coalesce("claimed_generated", F.lit(False)), F.col("expected_sha256")).isNotNull(), stale(F.coalesce("claimed_generated", F.lit(False)), F.col("expected_sha256")))
        .when(other & rpc & differs("operation"), F.when(F.col("_known"), "rpc_service_and_operation_not_matched").otherwise("missing_operation"))
        .when(other & differs("request_schema", "response_schema", "schema"), "schema_mismatch").when(other & queue & differs("namespace"), "namespace_mismatch").when(other, "binding_contract_identity_mismatch")
        .when(F.col("contract_reason").isNotNull(), F.col("contract_reason"))
        .when(F.col("_n").isNull(), F.when(F.col("role") == "producer", "missing_consumer_binding").otherwise("missing_server_binding")).when(F.col("_n") > 1, "duplicate_endpoint_bindings")
        .when(stale(F.col("_bad").isNotNull(), F.col("_expected")).isNotNull(), stale(F.col("_bad").isNotNull(), F.col("_expected"))).when(F.col("_why").isNotNull(), F.col("_why"))
    )
    ok = reason.isNull()
    return j.select(F.col("id").alias("binding_id"), F.when(ok, F.col("_e")).alias("target_binding_id"), F.when(ok, "resolved").otherwise("unresolved").alias("certainty"), reason.alias("reason"))


def memberships(bindings: DataFrame, witnesses: DataFrame) -> DataFrame:
    """``path, site_id``: every file a binding's match depends on, each once."""
    return bindings.select(F.col("id").alias("site_id"), "contract_id").join(witnesses.select("contract_id", "path"), "contract_id").select("path", "site_id").distinct()
