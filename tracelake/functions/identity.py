"""Identities of the form ``value@authority``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.text import strip

# The reserved authorities, the known ones with their labels, and
# the shapes checked.
LOCAL_AUTHORITY = "local"
ALIAS_AUTHORITY = "localid"
KEY_AUTHORITY = "key"
AUTHORITY_LABELS = {
    "local": "local name, not unique",
    "orcid.org": "ORCID",
    "github.com": "GitHub",
    "key": "signed key (not yet issued)",
    "localid": "local petname",
}
ORCID_SHAPE = r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$"
GITHUB_SHAPE = r"^[A-Za-z0-9]+(-[A-Za-z0-9]+)*$"
GITHUB_MAX_LENGTH = 39
DOMAIN_SHAPE = (r"^[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
                r"(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*\.[A-Za-z]{2,}$")
DOMAIN_MAX_LENGTH = 253
USER_FORBIDDEN = r"[\s/|]"


def _strip(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit("")))


def explicit(name: Column) -> Column:
    return _strip(name).contains("@")


def value_of(name: Column) -> Column:
    """What stands before the last ``@``."""
    raw = _strip(name)
    return F.when(raw.contains("@"), F.regexp_extract(raw, r"(?s)^(.*)@[^@]*$", 1)).otherwise(raw)


def authority_of(name: Column) -> Column:
    raw = _strip(name)
    return F.when(raw.contains("@"), F.lower(F.substring_index(raw, "@", -1))).otherwise(
        LOCAL_AUTHORITY)


def qualified(name: Column) -> Column:
    return F.concat(value_of(name), F.lit("@"), authority_of(name))


def orcid_check_digit(digits: Column) -> Column:
    """ISO 7064 MOD 11-2 check character of the first 15 digits."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(15)), F.lit(0).cast("bigint"),
        lambda acc, i: (acc + F.substring(digits, i, F.lit(1)).cast("bigint")) * 2)
    rest = (12 - total % 11) % 11
    return F.when(rest == 10, "X").otherwise(rest.cast("string"))


def user_problem(name: Column) -> Column:
    raw = _strip(name)
    return F.when(raw == "", "empty").when(raw.rlike(USER_FORBIDDEN), "illegal_character")


def paste_hint(name: Column) -> Column:
    """For a pasted profile address, the identity that was probably meant."""
    raw = _strip(name)
    tail = F.substring_index(F.regexp_replace(raw, r"/+$", ""), "/", -1)
    head = F.substring_index(F.substring_index(raw, "//", -1), "/", 1)
    return F.when(raw.contains("/") & (tail != "") & (head != "") & (tail != head),
                  F.concat(tail, F.lit("@"), head))


def identity_error(name: Column) -> Column:
    """A certain mistake in a new identity; null when there is none."""
    value, authority = value_of(name), authority_of(name)
    digits = F.regexp_replace(value, "-", "")
    return (
        F.coalesce(
            user_problem(name),
            F.when(authority == ALIAS_AUTHORITY, "alias_reserved")
            .when(value == "", "no_value")
            .when(explicit(name) & (authority == ""), "no_authority")
            .when(authority == KEY_AUTHORITY, "key_reserved")
            .when(authority == "github.com", F.when(
                ~value.rlike(GITHUB_SHAPE) | (F.length(value) > GITHUB_MAX_LENGTH), "bad_github"))
            .when(authority == "orcid.org", F.when(~value.rlike(ORCID_SHAPE), "bad_orcid_shape")
                  .when(F.substring(value, -1, 1) != orcid_check_digit(digits),
                        "bad_orcid_check_digit")),
        )
    )


def identity_warning(name: Column) -> Column:
    """Something doubtful in an identity that is not certainly wrong."""
    authority = authority_of(name)
    known = authority.isin(*AUTHORITY_LABELS)
    domain = authority.rlike(DOMAIN_SHAPE) & (F.length(authority) <= DOMAIN_MAX_LENGTH)
    return F.when(identity_error(name).isNull(),
                  F.when(authority == LOCAL_AUTHORITY, "local_only")
                  .when(~known & ~domain, "not_a_domain"))


def authority_label(name: Column) -> Column:
    authority = authority_of(name)
    out = authority
    for key, label in AUTHORITY_LABELS.items():
        out = F.when(authority == key, label).otherwise(out)
    return out


def owner_claimed(owner: Column, local_user: Column, declared: Column) -> Column:
    """Whether an owner is somebody's assertion that arrived with the data."""
    filled = F.coalesce(owner, F.lit("")) != ""
    return declared & filled & (owner != F.coalesce(local_user, F.lit("")))


def owner_display(owner: Column, local_user: Column, declared: Column) -> Column:
    return F.concat(F.coalesce(owner, F.lit("")), F.when(
        owner_claimed(owner, local_user, declared), " (claimed)").otherwise(""))
