"""One English sentence per event, built from fixed templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import canon, fixed

COMMAND_CHARS = 160


def _known(col: str) -> Column:
    return canon.not_in(F.col(col), [""])


def _machine(*refs: str) -> Column:
    """First name or address among the endpoints, in order."""
    return F.coalesce(*[_known(f"{ref}.{part}") for ref in refs for part in ("hostname", "ip")])


def _opt(prefix: str, value: Column, suffix: str = "") -> Column:
    return F.coalesce(F.concat(F.lit(prefix), value, F.lit(suffix)), F.lit(""))


def command_excerpt(cmdline: Column) -> Column:
    """Command line on one line, shortened for display only."""
    line = canon.not_in(canon.strip(F.regexp_replace(cmdline, r"\s+", " ")), [""])
    short = F.concat(canon.strip(F.substring(line, 1, COMMAND_CHARS)), F.lit("…"))
    return F.when(F.length(line) > COMMAND_CHARS, short).otherwise(line)


def sentence() -> Column:
    """What the event says happened; needs the full event schema."""
    c = F.col
    user = F.coalesce(canon.canon_user(c("actor.user")), _known("actor.user"), F.lit("an unknown user"))
    host = F.coalesce(_machine("device", "dst", "src"), F.lit("an unidentified machine"))
    opener = _machine("src", "device")
    port = F.when(c("dst.port") > 0, F.concat(F.lit(":"), c("dst.port").cast("string"))).otherwise("")
    target = F.coalesce(_known("domain"), _known("app"), _known("dst.hostname"),
                        F.concat(_known("dst.ip"), port), F.lit("an unknown destination"))
    origin = _machine("src")
    came_from = F.when(origin != host, F.concat(F.lit(" from "), origin)).otherwise("")
    login_to = F.when(_known("app").isNotNull(), target).otherwise(host)
    witness = F.when((opener.isNull()) | (c("device.hostname") != opener), _opt(", reported by ", _known("device.hostname"))).otherwise("")
    blocked = F.coalesce((c("activity") == "blocked") | (c("status") == "failure"), F.lit(False))
    say = F.concat
    text = F.lit
    verb = (F.when(c("activity") == "delete", "deleted").when(c("activity") == "modify", "modified")
            .when(c("activity") == "read", "read").otherwise("created"))
    cls = c("class_name")
    return (
        F.when(cls == fixed.DETECTION_FINDING, say(text("Alert '"), F.coalesce("message", F.lit("")), text("' fired on "), host, text(".")))
        .when((cls == fixed.AUTHENTICATION) & (c("status") == "failure"),
              say(user, text(" failed to sign in to "), login_to, came_from, text(".")))
        .when((cls == fixed.AUTHENTICATION) & (c("activity") == "logon_remote"),
              say(user, text(" opened a remote session on "), login_to, came_from, text(".")))
        .when(cls == fixed.AUTHENTICATION, say(user, text(" signed in to "), login_to, came_from, text(".")))
        .when(cls == fixed.PROCESS_ACTIVITY,
              say(user, text(" ran "), F.coalesce(_known("process.name"), F.lit("a process")), text(" on "), host,
                  _opt(", started by ", _known("process.parent_name")),
                  _opt(" as `", command_excerpt(c("process.cmdline")), "`"), text(".")))
        .when((cls == fixed.NETWORK_ACTIVITY) & (opener.isNull() | (opener == target)),
              say(text("A connection to "), target, F.when(blocked, " was blocked").otherwise(" was seen"), witness, text(".")))
        .when((cls == fixed.NETWORK_ACTIVITY) & blocked,
              say(text("A connection from "), opener, text(" to "), target, text(" was blocked"), witness, text(".")))
        .when(cls == fixed.NETWORK_ACTIVITY,
              say(opener, text(" connected to "), target, _opt(" through ", _known("process.name")), witness, text(".")))
        .when(cls == fixed.FILE_ACTIVITY,
              say(F.coalesce(_known("process.name"), user), text(" "), verb, text(" "),
                  F.coalesce(_known("file.name"), F.lit("a file")), _opt(" at ", _known("file.path")), text(" on "), host, text(".")))
        .when(cls == fixed.DNS_ACTIVITY,
              say(F.coalesce(opener, host), text(" resolved "), F.coalesce(_known("domain"), F.lit("an unknown domain")), text(".")))
        .when(cls == fixed.EMAIL_ACTIVITY,
              say(F.coalesce(_known("email.sender"), F.lit("An unknown sender")), text(" mailed "),
                  F.coalesce(_known("email.recipient"), F.lit("an internal mailbox")),
                  _opt(" about '", _known("email.subject"), "'"), text(".")))
        .when(cls == fixed.ACCOUNT_CHANGE, say(text("Account "), user, text(" was created or changed on "), host, text(".")))
        .otherwise(F.coalesce(_known("message"), say(text("Event "), c("activity"), text(" on "), host, text("."))))
    )
