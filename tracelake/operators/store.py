"""Content stores and asset versions: sharing, reachability, caps, policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import policy as pol
from tracelake.functions.times import instant
from tracelake.operators.skew import attach, previous_in_groups, running_sum

ASSET = ["archive", "asset_id"]


def with_archive_settings(assets: DataFrame, archives: DataFrame,
                          settings: dict[str, Column] | None = None) -> DataFrame:
    """Assets with their archive's settings and the policy these resolve to.

    ``settings`` replaces archive columns, to ask what other settings would do.
    The archive table joins by its measured size, without a hint.
    """
    own = archives.select(
        "archive", "asset_policy", "periodic_above", "manual_above",
        F.col("period_days").alias("_days"), F.col("max_snapshots").alias("_max_n"),
        F.col("max_snapshot_bytes").alias("_max_bytes"))
    if settings:
        own = own.withColumns(settings)
    return (
        assets.join(own, "archive")
        .withColumn("resolved", pol.effective_policy(
            F.col("policy"), F.col("size"), F.col("asset_policy"), F.col("periodic_above"),
            F.col("manual_above")))
        .withColumn("days", F.coalesce("period_days", "_days"))
        .withColumn("cap_count", F.coalesce("max_snapshots", "_max_n"))
        .withColumn("cap_bytes", F.coalesce("max_snapshot_bytes", "_max_bytes"))
        .withColumn("auto_max", F.coalesce(
            F.col("auto_max_bytes") if "auto_max_bytes" in assets.columns
            else F.lit(None).cast("bigint"), F.col("manual_above")))
        .drop("_days", "_max_n", "_max_bytes")
    )


# -- captured code ------------------------------------------------------------

def manifest_statistics(manifest_files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Files, blobs, shared and unique files of every manifest.

    Equal (manifest, blob) pairs are merged first; a blob used by very many
    manifests is split when its number of users is joined back.
    """
    pairs = manifest_files.groupBy("manifest", "blob").agg(F.count("*").alias("n"))
    users = pairs.groupBy("blob").agg(F.count("*").alias("users"))
    present = blobs.select(F.col("digest").alias("blob"), F.lit(True).alias("here")).distinct()
    users = users.join(present, "blob", "left")
    return (
        attach(pairs, users, ["blob"], "users", ["manifest"], "inner").groupBy("manifest")
        .agg(F.sum("n").alias("n_files"), F.count("*").alias("n_blobs"),
             F.count_if("here").alias("blobs_present"),
             F.sum(F.when(F.col("users") > 1, F.col("n")).otherwise(0)).alias("shared"),
             F.sum(F.when(F.col("users") > 1, 0).otherwise(F.col("n"))).alias("unique"))
    )


def files_per_repo(manifest_files: DataFrame) -> DataFrame:
    return (manifest_files.groupBy("manifest", F.substring_index("path", "/", 1).alias("repo"))
            .agg(F.count("*").alias("n")).orderBy("manifest", F.desc("n"), "repo"))


# -- A12, R1, R2: who claims what, and what nothing reaches ---------------------

def code_claims(sidecars: DataFrame, include_trash: bool = True) -> DataFrame:
    """(manifest, claimant) rows; a trashed sidecar can come back, so it counts."""
    kept = sidecars if include_trash else sidecars.where(~F.col("trashed"))
    return kept.where("code is not null").select(
        F.col("code").alias("digest"), F.concat_ws("/", "archive", "run_id", "filename").alias("claimant"))


def asset_claims(snapshots: DataFrame, edges: DataFrame) -> DataFrame:
    """(blob, claimant) rows: retained snapshots and pinned references.

    Either keeps a blob. A pin outranks the cap that evicted the snapshot.
    """
    kept = snapshots.where("not pending_gc").select(
        F.col("sha256").alias("digest"), F.col("asset_id").alias("claimant"))
    pinned = edges.where("ref_asset is not null and ref_sha256 is not null and ref_fidelity = 'pinned'").select(
        F.col("ref_sha256").alias("digest"), F.concat_ws("/", "archive", "run_id", "filename").alias("claimant"))
    return kept.unionByName(pinned)


def claim_counts(claims: DataFrame) -> DataFrame:
    """How many claim each digest, and the first of them by name."""
    return claims.groupBy("digest").agg(F.count("*").alias("n_claims"), F.min("claimant").alias("first_claimant"))


def dead_code(manifests: DataFrame, manifest_files: DataFrame, blobs: DataFrame,
              claims: DataFrame) -> DataFrame:
    """Manifests no sidecar names and blobs no live manifest lists."""
    live = claims.select(F.col("digest").alias("manifest"))
    dead_manifests = manifests.join(live, "manifest", "left_anti")
    reached = manifest_files.join(live, "manifest", "left_semi").select(F.col("blob").alias("digest"))
    dead_blobs = blobs.join(reached, "digest", "left_anti")
    return dead_manifests.select(F.lit("manifest").alias("kind"), F.col("manifest").alias("digest"), "bytes").unionByName(
        dead_blobs.select(F.lit("blob").alias("kind"), "digest", "bytes"))


def dead_asset_blobs(blobs: DataFrame, claims: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Blobs nothing claims (R2); none at all while a record cannot be read.

    An unreadable record might claim anything, so one such row empties the
    answer. The test is a join on a constant against at most one row.
    """
    blocked = unreadable.limit(1).select(F.lit(1).alias("_one"))
    dead = blobs.join(claims.select("digest"), "digest", "left_anti")
    return dead.withColumn("_one", F.lit(1)).join(blocked, "_one", "left_anti").drop("_one")


# -- W4-W7: versions and caps ---------------------------------------------------

def snapshot_caps(snapshots: DataFrame, capped: DataFrame) -> DataFrame:
    """Retained snapshots with ``evict`` set by the count cap, then the byte cap.

    ``capped`` has cap_count and cap_bytes per asset (0 or null: no cap). The
    newest version always stays. A version over the byte cap is evicted but still
    counts into the running total.
    """
    caps = capped.select(*ASSET, "cap_count", "cap_bytes")
    live = snapshots.where("not pending_gc").select(*ASSET, "ord", "at_day", "bytes")
    newest = running_sum(live, ASSET, F.col("at_day"), [F.desc("ord")], F.lit(1).cast("bigint"),
                         "nth", slice_descending=True)
    ranked = newest.join(caps, ASSET, "left").withColumn(
        "over_count", (F.coalesce("cap_count", F.lit(0)) > 0) & (F.col("nth") > F.col("cap_count")))
    counted = ranked.where("not over_count")
    total = running_sum(counted, ASSET, F.col("at_day"), [F.desc("ord")],
                        F.coalesce("bytes", F.lit(0)), "total", slice_descending=True)
    over_bytes = (F.coalesce("cap_bytes", F.lit(0)) > 0) & (F.col("nth") > 1) & (F.col("total") > F.col("cap_bytes"))
    kept = total.select(*ASSET, "ord", "bytes", F.lit(False).alias("over_count"), over_bytes.alias("over_bytes"))
    dropped = ranked.where("over_count").select(*ASSET, "ord", "bytes", "over_count", F.lit(False).alias("over_bytes"))
    return kept.unionByName(dropped).withColumn("evict", F.col("over_count") | F.col("over_bytes"))


def apply_caps(snapshots: DataFrame, capped: DataFrame, action: str = "mark") -> DataFrame:
    """Snapshots after eviction: marked for collection, or forgotten."""
    evicted = snapshot_caps(snapshots, capped).where("evict").select(*ASSET, "ord", F.lit(True).alias("_evict"))
    out = snapshots.join(evicted, [*ASSET, "ord"], "left")
    marked = out.withColumn("pending_gc", F.col("pending_gc") | F.coalesce("_evict", F.lit(False))).drop("_evict")
    return marked.where("not pending_gc") if action == "drop" else marked


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Newest version per asset whose bytes are still claimed."""
    fields = [c for c in snapshots.columns if c not in ASSET]
    return (snapshots.where("not pending_gc").groupBy(*ASSET)
            .agg(F.max_by(F.struct(*fields), "ord").alias("s")).select(*ASSET, *[f"s.{f}" for f in fields]))


def changed_versions(observed: DataFrame) -> DataFrame:
    """Of a sequence of looks at an asset, those worth storing."""
    seen = previous_in_groups(observed, ASSET, F.col("at_day"), ["ord"], "sha256", "before")
    return seen.where(~F.col("before").eqNullSafe(F.col("sha256"))).drop("before")


def snapshot_counts(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy(*ASSET).agg(
        F.count_if(~F.col("pending_gc")).alias("retained"), F.count("*").alias("total"))


# -- R3-R5, J17, J19 --------------------------------------------------------------

def due_for_snapshot(assets: DataFrame, latest: DataFrame, now: Column) -> DataFrame:
    """Assets whose period has passed, or that have no dated version.

    ``assets`` carries ``days``; ``latest`` carries ``at``.
    """
    last = latest.select(*ASSET, F.col("sha256").alias("latest_sha256"), F.col("at").alias("latest_at"))
    since = F.unix_timestamp(now) - F.unix_timestamp(instant(F.col("latest_at")))
    return assets.join(last, ASSET, "left").withColumn(
        "due", F.coalesce(since >= F.col("days") * 86400, F.lit(True)))


def reference_fidelity(requests: DataFrame, due: DataFrame) -> DataFrame:
    """What each reference to an asset can promise: pinned or observed.

    ``requests`` has ``pin`` (true, false or null for "as the policy says"); the
    asset side comes from :func:`due_for_snapshot`. Missing files are refused.
    """
    wanted = F.coalesce(F.col("pin"), F.col("resolved").isin("on_reference", "every_change")
                        | ((F.col("resolved") == "periodic") & F.col("due")))
    forced = F.coalesce(F.col("pin"), F.lit(False))
    fits = (F.coalesce("auto_max", F.lit(0)) == 0) | (F.col("live_size") <= F.col("auto_max"))
    stored = F.coalesce(F.col("latest_sha256") == F.col("live_sha256"), F.lit(False))
    return requests.join(due, ASSET).withColumn(
        "fidelity", F.when(F.col("live_name").isNull(), F.lit(None))
        .when(wanted & (forced | fits | stored), "pinned").otherwise("observed")
    ).withColumn("refused", F.when(F.col("live_name").isNull(), "no file"))


def scan_assets(assets: DataFrame) -> DataFrame:
    """Record against disk: renamed, edited or missing.

    Bytes are compared only where size or time moved or no hash was known.
    """
    missing = F.col("live_name").isNull()
    moved = (F.col("sha256").isNull() | ~F.col("size").eqNullSafe(F.col("live_size")))
    if "mtime" in assets.columns:
        moved = moved | ~F.col("mtime").eqNullSafe(F.col("live_mtime"))
    return assets.select(
        *ASSET, missing.alias("missing"),
        (~missing & (F.coalesce("name", F.lit("")) != "") & (F.col("live_name") != F.col("name"))).alias("renamed"),
        (~missing & moved).alias("touched"),
        (~missing & moved & ~F.col("sha256").eqNullSafe(F.col("live_sha256"))).alias("changed"))


def check_settings(settings: dict) -> None:
    """Refuse settings under which a rung of the ladder could never be reached."""
    for key in ("periodic_above", "manual_above", "period_days"):
        value = settings.get(key)
        if value is not None and (not isinstance(value, int) or value < 0):
            raise ValueError(f"{key} must be a whole number, not negative")
    low = settings.get("periodic_above", pol.DEFAULT_PERIODIC_ABOVE)
    high = settings.get("manual_above", pol.DEFAULT_MANUAL_ABOVE)
    if low >= high:
        raise ValueError("periodic_above must be below manual_above")
    if settings.get("period_days", 1) < 1:
        raise ValueError("period_days must be at least 1")
    policy = settings.get("asset_policy")
    if policy is not None and (policy == pol.AUTO or policy not in pol.POLICIES):
        raise ValueError(f"{policy!r} cannot be an archive's own policy")


def policy_preview(assets: DataFrame, archives: DataFrame, proposed: dict) -> DataFrame:
    """Assets following the archive whose policy other settings would change."""
    check_settings(proposed)
    auto = assets.where(F.coalesce("policy", F.lit("auto")).isin("auto", ""))
    was = with_archive_settings(auto, archives).select(*ASSET, "name", "size", F.col("resolved").alias("was"))
    literals = {k: F.lit(v) for k, v in proposed.items() if k != "period_days"}
    now = with_archive_settings(auto, archives, literals).select(*ASSET, F.col("resolved").alias("now"))
    return was.join(now, ASSET).where("was <> now").orderBy(F.desc("size"), *ASSET)


def asset_detail(snapshots: DataFrame, blobs: DataFrame) -> DataFrame:
    """Versions of every asset, newest first, and whether bytes survive."""
    here = blobs.select(F.col("digest").alias("sha256"), F.lit(True).alias("_here")).distinct()
    return (snapshots.join(here, "sha256", "left")
            .withColumn("recoverable", F.coalesce("_here", F.lit(False))).drop("_here")
            .orderBy(*ASSET, F.desc("ord")))


# -- N2 ------------------------------------------------------------------------

def rate_limited(events: DataFrame, days: Column) -> DataFrame:
    """Looks at an asset that take a snapshot, at most one per period.

    ``events``: archive, asset_id, ts, event_id. A look is taken when none was
    before it, or the last taken one is at least ``days`` old. Each look's
    successor is the first look a period later; the taken looks are the chain of
    successors from the first. Chains are followed by doubling the stride, so
    the longest chain of n looks needs log2(n) joins, and no asset is ever walked
    by one task.
    """
    from tracelake.session import stage

    at = F.struct("ts", "event_id")
    looks = stage(events.select(*ASSET, "ts", "event_id", days.alias("_days")), "looks")
    probes = looks.select(
        *ASSET, F.expr("ts + make_dt_interval(_days)").alias("t"), F.lit(0).alias("k"), at.alias("look"))
    marks = looks.select(*ASSET, F.col("ts").alias("t"), F.lit(1).alias("k"), at.alias("look"))
    line = probes.unionByName(marks).withColumn("_slice", F.to_date("t")).withColumn(
        "_event", F.when(F.col("k") == 1, F.col("look")))
    here = Window.partitionBy(*ASSET, "_slice").orderBy("t", "k", "look").rowsBetween(
        Window.currentRow, Window.unboundedFollowing)
    later = Window.partitionBy(*ASSET).orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    slices = line.groupBy(*ASSET, "_slice").agg(F.min("_event").alias("_first")).withColumn(
        "_later", F.min("_first").over(later)).drop("_first")
    succeeding = (
        line.withColumn("_next", F.min("_event").over(here)).where("k = 0")
        .join(slices, [*ASSET, "_slice"])
        .select(*ASSET, "look", F.coalesce("_next", "_later").alias("after")).where("after is not null")
    )
    jump = stage(succeeding, "jump-0")
    taken = stage(looks.groupBy(*ASSET).agg(F.min(at).alias("look")), "taken-0")
    i = 0
    while True:
        i += 1
        reached = taken.join(jump, [*ASSET, "look"]).select(*ASSET, F.col("after").alias("look"))
        fresh = stage(reached.join(taken, [*ASSET, "look"], "left_anti"), f"taken-{i}")
        if fresh.isEmpty():
            break
        taken = taken.unionByName(fresh)
        further = jump.select(*ASSET, F.col("look").alias("after"), F.col("after").alias("beyond"))
        jump = stage(jump.join(further, [*ASSET, "after"]).select(
            *ASSET, "look", F.col("beyond").alias("after")), f"jump-{i}")
    return taken.select(*ASSET, "look.ts", "look.event_id")
