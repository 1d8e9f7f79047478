"""Access review (G5): which logged actions were allowed by the role model.

The role -> permission table is fixed (4 roles x 12 permissions, 27 grants),
so it is broadcast unconditionally; the user table is joined with a
size-checked broadcast. Inactive users and unknown users hold no permission.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import sized_join

# Roles, permissions and the grants of each role.
ROLES = ["admin", "data_owner", "data_analyst", "viewer"]
PERMISSIONS = [
    "read_data", "write_data", "mask_data", "anonymize_data", "configure_profile", "view_audit_logs",
    "manage_users", "export_data", "delete_data", "configure_k_anonymity", "configure_l_diversity",
    "configure_diff_privacy",
]
ROLE_PERMISSIONS = {
    "admin": [
        "read_data", "write_data", "mask_data", "anonymize_data", "configure_profile", "view_audit_logs",
        "manage_users", "export_data", "delete_data", "configure_k_anonymity", "configure_l_diversity",
        "configure_diff_privacy",
    ],
    "data_owner": [
        "read_data", "write_data", "mask_data", "anonymize_data", "configure_profile", "export_data",
        "configure_k_anonymity", "configure_l_diversity", "configure_diff_privacy",
    ],
    "data_analyst": ["read_data", "export_data"],
    "viewer": ["read_data"],
}


def role_permissions(spark: SparkSession) -> DataFrame:
    rows = [(r, p) for r in ROLES for p in ROLE_PERMISSIONS[r]]
    return spark.createDataFrame(rows, "role string, permission string")


def access_review(access: DataFrame, users: DataFrame, user_col: str = "user",
                  permission_col: str = "permission") -> DataFrame:
    """Tag each access row with ``role``, ``active`` and ``granted``.

    ``users`` has ``(username, role, active)``. ``granted`` is true only for an
    active, known user whose role holds the requested permission.
    """
    spark = access.sparkSession
    u = users.select(F.col("username").alias(user_col), "role", "active")
    with_user = sized_join(access, u, [user_col], "left")
    grants = F.broadcast(role_permissions(spark).withColumn("_grant", F.lit(True)))
    j = with_user.join(grants, (with_user["role"] == grants["role"]) &
                       (with_user[permission_col] == grants["permission"]), "left")
    granted = F.coalesce(F.col("active"), F.lit(False)) & F.coalesce(F.col("_grant"), F.lit(False))
    return j.select(*[with_user[c] for c in with_user.columns], granted.alias("granted"))


def access_violations(reviewed: DataFrame) -> DataFrame:
    """Rows whose action was not granted."""
    return reviewed.where(~F.col("granted"))
