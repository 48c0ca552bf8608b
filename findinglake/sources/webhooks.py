"""Webhook deliveries: signature check and routing, as columns."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values.enums import REVIEWABLE_ACTIONS
from ..functions.ranks import choose

PAYLOAD = (
    "action string, number bigint, pull_request struct<number:bigint,draft:boolean,head:struct<sha:string>>, "
    "repository struct<name:string,owner:struct<login:string>>"
)


def signature_state(body: Column, header: Column, secret: str) -> Column:
    """ok, or why a delivery is not trusted. The digest runs in Arrow batches;
    the secret travels with the function and is never a column."""
    key = secret.encode()

    @F.pandas_udf(T.BooleanType())
    def signed(bodies: pd.Series, headers: pd.Series) -> pd.Series:
        def same(text: str, given: str) -> bool:
            wanted = "sha256=" + hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
            return hmac.compare_digest(wanted.encode(), given.encode())

        return pd.Series([bool(g) and same(t or "", g) for t, g in zip(bodies, headers)])

    if not secret:
        return F.lit("missing-secret")
    absent = header.isNull() | (header == "")
    return choose(
        [
            (absent, F.lit("missing-signature")),
            (~header.startswith("sha256="), F.lit("malformed-signature")),
            (signed(body, header), F.lit("ok")),
        ],
        F.lit("mismatch"),
    )


def parse_events(deliveries: DataFrame) -> DataFrame:
    """Route each delivery. deliveries: delivery, event, payload (JSON text)."""
    p = F.col("p")
    owner, repo = p["repository"]["owner"]["login"], p["repository"]["name"]
    number = F.coalesce(p["pull_request"]["number"], p["number"])
    sha = p["pull_request"]["head"]["sha"]
    action = F.coalesce(p["action"], F.lit(""))
    draft = F.coalesce(p["pull_request"]["draft"], F.lit(False))
    complete = (
        (F.coalesce(owner, F.lit("")) != "") & (F.coalesce(repo, F.lit("")) != "")
        & (F.coalesce(number, F.lit(0)) != 0) & (F.coalesce(sha, F.lit("")) != "")
    )
    is_pull = F.coalesce(F.col("event") == "pull_request", F.lit(False))
    reason = (
        F.when(F.col("event") == "ping", F.lit(None))
        .when(~is_pull, F.concat(F.lit("unhandled event type: "), F.coalesce("event", F.lit("unknown"))))
        .when(~action.isin(*REVIEWABLE_ACTIONS), F.concat(F.lit("pull_request action not reviewable: "), action))
        .when(~complete, F.lit("payload missing repository or pull request fields"))
        .when(draft & (action != "ready_for_review"), F.lit("pull request is a draft"))
    )
    kind = F.when(F.col("event") == "ping", "ping").when(F.col("reason").isNotNull(), "ignored").otherwise("pull_request")
    routed = deliveries.withColumn("p", F.from_json("payload", PAYLOAD)).withColumn("reason", reason)

    def only(value: Column) -> Column:
        return F.when(F.col("kind") == "pull_request", value)

    return routed.withColumn("kind", kind).select(
        "delivery", "kind", "reason", only(owner).alias("owner"), only(repo).alias("repo"),
        only(number).alias("pull_number"), only(action).alias("action"), only(sha).alias("head_sha"),
        only(draft).alias("draft"),
    )
