"""Users, logins, owners and permissions that have drifted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions import concat_nullsafe, holds, like_ci, quotename
from opslens.operators.ranking import numbered
from opslens.sources.workdir import reliable_checkpoint

# Principal type codes.
GROUP_USER = "G"
WINDOWS_LOGIN_TYPES = ("U", "G")
MAPPABLE_TYPES = ("S", "U")
CONNECTING_TYPES = ("U", "S", "G", "C", "K", "E", "X")
CONNECT = "CO"
GRANTED_STATES = ("G", "W")
PRIMARY_CHECK = "fn_hadr_is_primary_replica"

LAST_SYSTEM_ID = 4


def _use(database: str = "database_name") -> Column:
    return concat_nullsafe("USE ", quotename(database), "; ")


def orphan_users(users: DataFrame, logins: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Group users whose sid belongs to no login."""
    keys = [*scope, "sid"]
    return (
        users.where(F.col("type") == GROUP_USER)
        .join(logins.where(F.col("sid").isNotNull()).select(*keys), keys, "left_anti")
        .withColumn("action", F.lit("DROP_USER"))
        .withColumn("command_text", F.concat(_use(), F.lit("DROP USER "), quotename("name")))
    )


def wrong_default_schema(users: DataFrame, expected: str = "dbo") -> DataFrame:
    """Users with another default schema; a missing schema is not reported."""
    return (
        users.where((F.col("name") != "guest") & (F.col("default_schema_name") != expected))
        .withColumn("action", F.lit("SET_DEFAULT_SCHEMA"))
        .withColumn(
            "command_text",
            F.concat(
                _use(),
                F.lit("ALTER USER "),
                quotename("name"),
                F.lit(f" WITH DEFAULT_SCHEMA=[{expected}]"),
            ),
        )
    )


def wrong_domain(logins: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Windows logins and groups whose domain is not on the allow-list."""
    domain = F.substring_index("name", "\\", 1)
    return (
        logins.where(F.col("type").isin(*WINDOWS_LOGIN_TYPES) & F.col("name").contains("\\"))
        .withColumn("domain", domain)
        .where(~F.upper("domain").isin([a.upper() for a in allowed]))
    )


def users_without_connect(users: DataFrame, permissions: DataFrame, *, scope: Sequence[str]) -> DataFrame:
    """Users for which CONNECT is missing or not granted.

    Principals are numbered per database: ``scope`` names the columns of server and database.
    """
    connect = permissions.where(F.col("type") == CONNECT).select(
        *scope, F.col("grantee_principal_id").alias("principal_id"), F.col("state").alias("connect_state")
    )
    granted = F.col("connect_state").isin(*GRANTED_STATES)
    return (
        users.where(
            F.col("type").isin(*CONNECTING_TYPES) & (F.col("principal_id") > LAST_SYSTEM_ID)
        )
        .join(connect, [*scope, "principal_id"], "left")
        .where(F.col("connect_state").isNull() | ~granted)
        .withColumn("has_db_access", holds(granted))
        .withColumn("action", F.lit("GRANT_CONNECT"))
        .withColumn("command_text", F.concat(_use(), F.lit("GRANT CONNECT TO "), quotename("name")))
    )


def owner_list(databases: DataFrame, logins: DataFrame, *, scope: Sequence[str]) -> DataFrame:
    """Databases with the login that owns them; ``scope`` names the server columns."""
    owners = logins.select(*scope, F.col("sid").alias("owner_sid"), F.col("name").alias("owner_name"))
    return databases.join(owners, [*scope, "owner_sid"], "left")


def db_owner_drift(
    databases: DataFrame,
    logins: DataFrame,
    system_sid: str,
    system_owner: str = "sa",
    *,
    scope: Sequence[str],
) -> DataFrame:
    """User databases owned by somebody other than the system owner."""
    drifted = databases.where(
        (F.col("database_id") > LAST_SYSTEM_ID) & (F.col("owner_sid") != system_sid)
    )
    return (
        owner_list(drifted, logins, scope=scope)
        .withColumn("action", F.lit("SET_DATABASE_OWNER"))
        .withColumn(
            "command_text",
            concat_nullsafe(
                "ALTER AUTHORIZATION ON DATABASE::", quotename("name"), " TO ",
                quotename(F.lit(system_owner)),
            ),
        )
    )


def job_owner_drift(
    jobs: DataFrame, logins: DataFrame, system_owner: str = "sa", *, scope: Sequence[str]
) -> DataFrame:
    """Jobs whose known owner is not the system owner."""
    owners = logins.where(F.col("name") != system_owner).select(
        *scope, F.col("sid").alias("owner_sid"), F.col("name").alias("owner_name")
    )
    return (
        jobs.join(owners, [*scope, "owner_sid"])
        .withColumn("action", F.lit("SET_JOB_OWNER"))
        .withColumn(
            "command_text",
            concat_nullsafe(
                "EXEC dbo.sp_update_job @job_id = '", F.col("job_id"),
                f"', @owner_login_name = '{system_owner}'",
            ),
        )
    )


def role_gap(
    logins: DataFrame,
    server_role_members: DataFrame,
    users: DataFrame,
    database_role_members: DataFrame,
    database_role: str,
    *,
    login_like: str = "%",
    create_users: bool = True,
    scope: Sequence[str],
    database: Sequence[str] = (),
) -> DataFrame:
    """Members of a server role whose database user is missing or lacks the database role.

    ``server_role_members`` and ``database_role_members`` hold the members of
    the two roles (``member_principal_id``).  With ``create_users`` off a
    missing user gets no add-member command either, because it would fail.

    ``scope`` names the server columns of all four; ``database`` those that tell databases apart among
    users and their roles.  With it the gap is judged in every database that has users.  The logins
    of a server then are numbered, and 64 of them compared at once: the word of those that have the role in a
    database is taken from the word of those wanted.  So logins are never paired with databases that hold them.
    """
    members = (
        logins.where(F.col("type").isin(*MAPPABLE_TYPES) & like_ci("name", login_like))
        .join(
            server_role_members.select(*scope, F.col("member_principal_id").alias("principal_id")).distinct(),
            [*scope, "principal_id"],
            "left_semi",
        )
        .select(*scope, "sid", F.col("name").alias("login_name"))
    )
    inside = [*scope, *database]
    if database and not scope:
        raise ValueError("database columns need the server columns in scope")
    with_role = (
        users.where(F.col("type").isin(*MAPPABLE_TYPES))
        .join(
            database_role_members.select(
                *inside, F.col("member_principal_id").alias("principal_id"), F.lit(True).alias("has_role")
            ).distinct(),
            [*inside, "principal_id"],
            "left",
        )
        .select(*inside, "sid", F.col("name").alias("user_name"), holds(F.col("has_role")).alias("has_role"))
    )
    missing = F.col("user_name").isNull()
    create = F.when(
        missing & F.lit(create_users),
        concat_nullsafe("CREATE USER ", quotename("login_name"), " FOR LOGIN ", quotename("login_name")),
    )
    add = F.when(
        ~missing | F.lit(create_users),
        concat_nullsafe(
            "ALTER ROLE ", quotename(F.lit(database_role)), " ADD MEMBER ",
            quotename(F.coalesce("user_name", "login_name")),
        ),
    )
    if database:
        members = _without_role(members, with_role, users.select(*inside).distinct(), scope, inside)
    return (
        members.join(with_role, [*inside, "sid"], "left")
        .where(~holds(F.col("has_role")))
        .select(
            *inside,
            "login_name",
            "user_name",
            create.alias("create_user_command"),
            add.alias("add_member_command"),
        )
    )


def _without_role(
    members: DataFrame, with_role: DataFrame, databases: DataFrame, scope: Sequence[str], inside: Sequence[str]
) -> DataFrame:
    """Every wanted login with every database of its server in which it lacks the role.

    A word of 64 logins that meets a database either shows a gap there, or as many members as it has logins.
    """
    scope, inside = list(scope), list(inside)
    wanted = numbered(members, scope, [F.col("sid"), F.col("login_name")], "__number")
    wanted = reliable_checkpoint(wanted)
    word, bit = F.floor(F.col("__number") / 64).alias("__word"), (F.col("__number") % 64).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = wanted.groupBy(*scope, word).agg(F.bit_or(mask).alias("__wanted"))
    holders = with_role.where("has_role").select(*inside, "sid").join(wanted, [*scope, "sid"])
    have = holders.groupBy(*inside, word).agg(F.bit_or(mask).alias("__have"))
    met = databases.join(words, scope).join(have, [*inside, "__word"], "left")
    gaps = met.withColumn("__gap", F.col("__wanted").bitwiseAND(F.bitwise_not(F.coalesce("__have", F.lit(0).cast("long")))))
    is_set = "filter(sequence(0, 63), b -> (shiftrightunsigned(__gap, b) & 1L) = 1L)"
    open_ = gaps.where("__gap <> 0").select(*inside, "__word", F.explode(F.expr(is_set)).alias("__bit"))
    open_ = open_.select(*inside, (F.col("__word") * 64 + F.col("__bit")).alias("__number"))
    return open_.join(wanted, [*scope, "__number"]).drop("__number")


def ag_job_steps(steps: DataFrame, replicated_databases: DataFrame) -> DataFrame:
    """T-SQL steps in replicated databases that do not yet check for the primary replica."""
    guarded = concat_nullsafe(
        f"IF sys.{PRIMARY_CHECK}(DB_NAME()) = 1\nBEGIN\n", F.col("command"), "\nEND"
    )
    return (
        steps.where(
            (F.col("subsystem") == "TSQL") & ~like_ci("command", f"%{PRIMARY_CHECK}%")
        )
        .join(replicated_databases.select("database_name"), "database_name", "left_semi")
        .withColumn("action", F.lit("GUARD_JOB_STEP"))
        .withColumn("new_command", guarded)
    )
