"""Access review and audit trail.

X1 needs every role that a user's role inherits from. Reach is computed by
doubling: pairs (role, reached role) of up to k steps, joined with themselves,
give those of up to 2k steps. It ends when no pair is new, after about
log2(height) rounds, and a cycle among roles ends it like anything else. Users
are joined afterwards, so the rounds touch the role dimension only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def inherited_roles(roles: DataFrame) -> DataFrame:
    """(role, reached): every role with itself and with all roles above it."""
    checkpoint_dir(roles.sparkSession)
    role, above = F.col("perfil_id").alias("role"), F.col("perfil_pai_id").alias("reached")
    reach = (
        roles.select(role, F.col("perfil_id").alias("reached"))
        .unionByName(roles.where(F.col("perfil_pai_id").isNotNull()).select(role, above))
        .distinct().checkpoint()
    )
    known, n = 0, reach.count()
    while n > known:
        onward = reach.select(F.col("role").alias("via"), F.col("reached").alias("target"))
        reach = (
            reach.join(onward, F.col("reached") == F.col("via"))
            .select("role", F.col("target").alias("reached")).distinct().checkpoint()
        )
        known, n = n, reach.count()
    return reach


def effective_permissions(user_roles: DataFrame, roles: DataFrame, role_perms: DataFrame) -> DataFrame:
    """Distinct (usuario_id, permissao) after inheritance."""
    granted = (
        inherited_roles(roles).join(role_perms.select(F.col("perfil_id").alias("reached"), "permissao"), "reached")
        .select(F.col("role").alias("perfil_id"), "permissao").distinct()
    )
    return user_roles.join(granted, "perfil_id").select("usuario_id", "permissao").distinct()


def has_permission(requests: DataFrame, effective: DataFrame) -> DataFrame:
    """Each (usuario_id, permissao) request with ``permitido`` (an EXISTS test)."""
    granted = effective.select("usuario_id", "permissao").distinct().withColumn("_ok", F.lit(True))
    return requests.join(granted, ["usuario_id", "permissao"], "left").select(
        "usuario_id", "permissao", F.coalesce(F.col("_ok"), F.lit(False)).alias("permitido"))


def audit_changes(before: DataFrame, after: DataFrame, key: list[str], fields: list[str], acao: F.Column, entidade: str,
                  entidade_id: F.Column, at: F.Column, usuario: str = "system") -> DataFrame:
    """X3 as the difference of two states of a table: one audit record per row that is new, gone or changed.

    ``antes`` and ``depois`` hold the changed fields only, as JSON (a field that is null is left out there); ``campos``
    names them. The states meet in one full outer join on ``key``. ``acao``, ``entidade_id`` and ``at`` are
    expressions over the key and the structs ``a`` (before, null for a new row) and ``d`` (after, null for one that is gone).
    """
    old = before.select(*key, F.struct(*fields).alias("a"))
    new = after.select(*key, F.struct(*fields).alias("d"))
    both = old.join(new, key, "full_outer")
    differs = {f: ~F.col(f"a.{f}").eqNullSafe(F.col(f"d.{f}")) for f in fields}
    names = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in differs.items()]))

    def image(side: str) -> F.Column:
        return F.when(F.col(side).isNotNull(), F.to_json(F.struct(*[F.when(c, F.col(f"{side}.{f}")).alias(f) for f, c in differs.items()])))

    rows = both.withColumn("campos", names).where(F.size("campos") > 0)
    return rows.select(at.alias("ocorrido_em"), F.lit(usuario).alias("usuario_email"), acao.alias("acao"), F.lit(entidade).alias("entidade"),
                       entidade_id.cast("string").alias("entidade_id"), "campos", image("a").alias("antes"), image("d").alias("depois")).withColumn(
        "mes", F.date_format("ocorrido_em", "yyyyMM"))


def audit_rows(df: DataFrame, acao: str, entidade: str, id_col: F.Column, after_cols: list[str],
               usuario: str = "system", at: F.Column | None = None, before: F.Column | None = None) -> DataFrame:
    """One audit record per row with its month; before- and after-image as JSON.

    ``before`` is a struct column with the earlier state (null where there was none).
    """
    ts = at if at is not None else F.current_timestamp()
    antes = F.lit(None).cast("string") if before is None else F.when(before.isNotNull(), F.to_json(before))
    return df.select(
        ts.alias("ocorrido_em"), F.lit(usuario).alias("usuario_email"), F.lit(acao).alias("acao"),
        F.lit(entidade).alias("entidade"), id_col.cast("string").alias("entidade_id"), antes.alias("antes"),
        F.to_json(F.struct(*[F.col(c) for c in after_cols])).alias("depois"),
    ).withColumn("mes", F.date_format("ocorrido_em", "yyyyMM"))
