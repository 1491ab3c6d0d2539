"""Who is who: identity trails and archive lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import identity
from tracelake.operators.skew import attach


def current_identities(trail: DataFrame) -> DataFrame:
    """The id each contact uses now: the last listed, not the latest dated."""
    return trail.groupBy("petname").agg(
        F.max_by("id", "ord").alias("current"), F.min_by("display", F.when(F.col("display").isNotNull(), F.col("ord"))).alias("display"),
        F.count("*").alias("n_ids"))


def shared_identities(trail: DataFrame) -> DataFrame:
    """Ids listed under more than one contact: nobody can say whose they are."""
    return trail.groupBy("id").agg(F.countDistinct("petname").alias("n_contacts"),
                                   F.min("petname").alias("first_contact")).where("n_contacts > 1")


def consolidate(users: DataFrame, trail: DataFrame) -> DataFrame:
    """Each user with the contact behind it, the id in use and a label.

    An alias ``petname@localid`` becomes that contact's id; an unknown one is an
    error; any other unknown user passes through. ``users`` has a column user.
    """
    now = current_identities(trail)
    whose = trail.groupBy("id").agg(F.min("petname").alias("petname"))
    alias = identity.authority_of(F.col("user")) == identity.ALIAS_AUTHORITY
    known = users.withColumn("_alias", F.when(alias, identity.value_of(F.col("user"))))
    named = known.join(whose.select(F.col("id").alias("user"), F.col("petname").alias("_found")), "user", "left")
    named = named.withColumn("petname", F.coalesce("_alias", "_found"))
    contact = now.withColumn("_known", F.lit(True))
    got = named.join(contact, "petname", "left")
    return got.select(
        *users.columns, F.when(F.col("_known"), F.col("petname")).alias("petname"),
        F.when(alias & F.col("_known").isNull(), F.lit(None)).otherwise(F.coalesce("current", "user")).alias("current"),
        F.when(F.col("_known"), F.coalesce("display", "petname")).otherwise(F.col("user")).alias("label"),
        F.coalesce(F.col("current") == F.col("user"), F.lit(False)).alias("is_current"),
        F.when(alias & F.col("_known").isNull(), "no such contact").alias("error"))


def same_person(pairs: DataFrame, trail: DataFrame) -> DataFrame:
    """Whether two ids (a, b) belong to one contact."""
    whose = trail.groupBy("id").agg(F.min("petname").alias("p"))
    a = whose.select(F.col("id").alias("a"), F.col("p").alias("_a"))
    known = trail.select(F.col("petname").alias("_a"), F.col("id").alias("b"), F.lit(True).alias("_b")).distinct()
    return pairs.join(a, "a", "left").join(known, ["_a", "b"], "left").select(
        "a", "b", ((F.col("a") == F.col("b")) | F.coalesce("_b", F.lit(False))).alias("same"))


def find_archives(wanted: DataFrame, registry: DataFrame, me: str) -> DataFrame:
    """Registry entry each (name, owner) asks for.

    ``registry``: nickname, name, owner, ord. The declared name or the nickname
    counts. A named owner must be the entry's; an entry without one is mine. No
    owner asked takes the first. Entries are reduced per key before they join.
    """
    spelled = registry.select("nickname", "owner", "ord", F.explode(F.array_distinct(F.array("name", "nickname"))).alias("name"))
    first = F.min_by("nickname", "ord")
    any_owner = spelled.groupBy("name").agg(first.alias("_any"))
    by_owner = spelled.withColumn("owner", F.when(F.coalesce("owner", F.lit("")) == "", me).otherwise(F.col("owner"))).groupBy(
        "name", "owner").agg(first.alias("_owned"))
    return wanted.join(any_owner, "name", "left").join(by_owner, ["name", "owner"], "left").select(
        *wanted.columns, F.when(F.col("owner").isNull(), F.col("_any")).otherwise(F.col("_owned")).alias("nickname"))


def archive_locations(registry: DataFrame) -> DataFrame:
    """Places each archive is kept, over all its nicknames, first seen first.

    ``registry``: owner, name, nickname, location, ord.
    """
    key = ["owner", "name"]
    seen = registry.groupBy(*key, "location").agg(F.min(F.struct("nickname", "ord")).alias("first"))
    nicknames = registry.groupBy(*key).agg(F.countDistinct("nickname").alias("n_nicknames"), F.count("*").alias("_rows"))
    return attach(seen, nicknames, key, "_rows", ["location"], "inner").select(
        *key, "location", F.col("first.nickname").alias("nickname"), F.col("first.ord").alias("ord"), "n_nicknames"
    ).orderBy(*key, "nickname", "ord")
