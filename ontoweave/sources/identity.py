"""Identity-provider objects: organisations, users, directories, memberships."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.text import field


@dataclass(frozen=True)
class IdentityObject:
    name: str
    key: str
    parent: str | None = None
    link: bool = False


# The objects, their key columns, and the parent each is listed under.
OBJECTS = {
    o.name: o
    for o in [
        IdentityObject("organizations", "organization_id"),
        IdentityObject("users", "user_id"),
        IdentityObject("organization_memberships", "organization_membership_id", "organization_id"),
        IdentityObject("invitations", "invitation_id"),
        IdentityObject("sso_connections", "connection_id"),
        IdentityObject("directories", "directory_id"),
        IdentityObject("directory_users", "directory_user_id", "directory_id"),
        IdentityObject("directory_groups", "directory_group_id", "directory_id"),
        IdentityObject("directory_group_members", "directory_user_id", "directory_group_id", link=True),
    ]
}
# Which columns of an object refer to other objects.
LINKS = {
    "organization_memberships": ["organization_id", "user_id"],
    "invitations": ["organization_id"],
    "sso_connections": ["organization_id"],
    "directories": ["organization_id"],
    "directory_users": ["directory_id", "organization_id"],
    "directory_groups": ["directory_id", "organization_id"],
    "directory_group_members": ["directory_group_id", "directory_user_id"],
}
DROPPED = {"object"}
DEPRECATED = {"directory_users": {"groups"}}


def relationships() -> list[tuple[str, str, str, str]]:
    owner = {o.key: o.name for o in OBJECTS.values() if not o.link}
    return [(t, c, owner[c], c) for t, columns in LINKS.items() for c in columns]


def normalize(df: DataFrame, object_name: str, parent_column: str = "parent_id") -> DataFrame:
    """Rename ids, put the parent's id under its own name, drop wrapper fields.

    Listing an object under a parent lands the parent's id in ``parent_column``; a link
    object keeps only the two ids.
    """
    spec = OBJECTS[object_name]
    parent = [field(parent_column).alias(spec.parent)] if spec.parent else []
    if spec.link:
        return df.select(*parent, field("id").alias(spec.key))
    hidden = DROPPED | DEPRECATED.get(object_name, set()) | {parent_column, spec.parent}
    own = [
        field(c).alias(spec.key if c == "id" else c) for c in df.columns if c not in hidden
    ]
    # The row's own value of the parent column, where it has one, replaces the listing's.
    if spec.parent and spec.parent in df.columns:
        parent = [field(spec.parent)]
    return df.select(*parent, *own)
