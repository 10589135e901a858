"""Error classification and alert routing, as columns over an error table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions import text as T


def classify(raw_message: Column) -> tuple[Column, Column, Column]:
    """(code, retryable, message) for a failure text from the post source."""
    rate = raw_message.contains("rate limit") | raw_message.contains("429")
    unknown = raw_message.contains("unknown command")
    code = F.when(rate, "RATE_LIMIT").when(unknown, "UNKNOWN").otherwise("NETWORK")
    retryable = ~unknown | rate
    message = (
        F.when(rate, F.lit(fixed.ERROR_RATE_LIMIT))
        .when(unknown, F.lit(fixed.ERROR_UNKNOWN_COMMAND))
        .otherwise(F.concat(F.lit(fixed.ERROR_NETWORK_PREFIX), raw_message))
    )
    return code, retryable, message


def classify_other(raw_message: Column) -> tuple[Column, Column, Column]:
    """(code, retryable, message) for a failure from anywhere else."""
    return F.lit("UNKNOWN"), F.lit(False), raw_message


def error_icon(code: Column) -> Column:
    icons = F.create_map(*[F.lit(x) for kv in fixed.ERROR_ICONS.items() for x in kv])
    return F.coalesce(icons[code], F.lit(fixed.ERROR_ICON_DEFAULT))


def alerts(errors: DataFrame) -> DataFrame:
    """errors(raw_message, auth_valid, ...) -> one alert per error: an auth
    alert when a network or unknown failure coincides with an invalid login,
    else the error alert (message HTML-escaped).  A boolean column `from_source`
    tells failures of the post source from others (without it all are; NULL
    counts as another)."""
    raw = F.col("raw_message")
    both = zip(classify(raw), classify_other(raw))
    own = F.col("from_source") if "from_source" in errors.columns else F.lit(True)
    code, retryable, message = [F.when(own, a).otherwise(b) for a, b in both]
    df = errors.select("*", code.alias("code"), retryable.alias("retryable"), message.alias("message"))
    auth = F.col("code").isin("NETWORK", "UNKNOWN") & ~F.col("auth_valid")
    text = F.concat(
        error_icon(F.col("code")), F.lit(" <b>Curation Error</b>\n\n<b>Type:</b> "), F.col("code"),
        F.lit("\n<b>Message:</b> "), T.html_escape("message"),
        F.lit("\n<b>Status:</b> "),
        F.when(F.col("retryable"), F.lit(fixed.ALERT_RETRY)).otherwise(F.lit(fixed.ALERT_MANUAL)),
    )
    return df.select(
        "*",
        F.when(auth, "auth_expired").otherwise("error").alias("alert_kind"),
        F.substring(F.when(auth, F.lit(fixed.ALERT_AUTH)).otherwise(text), 1, fixed.MESSAGE_HARD_CUT).alias("text"),
    )


def stats_message(ledger: DataFrame, today: Column) -> DataFrame:
    """One message row (`text`): ledger rows in all, rows processed on the date
    `today` (UTC), and failed rows."""
    n = ledger.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.to_date("processed_at") == today).alias("today"),
        F.count_if(F.col("status") == "failed").alias("errors"),
    )
    return n.select(
        F.concat(
            F.lit(fixed.STATS_TITLE), F.lit("Total processed: "), F.col("total").cast("string"),
            F.lit("\nToday: "), F.col("today").cast("string"), F.lit("\nErrors: "), F.col("errors").cast("string"),
        ).alias("text")
    )
