"""Text rules: sensors, commands, intents, clean speech."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sensor_name(name: Column) -> Column:
    """Fixed sensor names by parts of the instrument's name, else the name in capitals; UNKNOWN if there is none."""
    low = F.lower(name)
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "UNKNOWN")
        .when(low.contains("ohrc") | low.contains("high resolution"), "OHRC")
        .when(low.contains("tmc") | low.contains("terrain mapping"), "TMC-2")
        .when(low.contains("iirs") | low.contains("infrared"), "IIRS")
        .otherwise(F.upper(name))
    )


#: White space of scripts, marks of formatting, the commands with their words and the intents with theirs.
WHITE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
MARKS = "[*_`#>]"
COMMANDS = {"run": ["run", "execute", "go"], "next": ["next", "forward"], "back": ["back", "previous"], "play": ["play"], "stop": ["stop", "pause", "halt"]}
INTENTS = {
    "accuracy": ["rmse", "accurate", "accuracy", "error", "precision"],
    "matches": ["inlier", "match", "keypoint", "feature", "consensus"],
    "provenance": ["provenance", "real", "synthetic", "derived", "simulated"],
}


def clean_text(text: Column, cap: int = 600) -> Column:
    """Text to be spoken: no code fences, marks of formatting or link targets, white space as one blank, at most ``cap`` characters."""
    plain = F.regexp_replace(text, r"(?s)```.*?```", "")
    plain = F.regexp_replace(plain, MARKS, "")
    plain = F.regexp_replace(plain, r"\[(.*?)\]\(.*?\)", "$1")
    return F.substring(F.trim(F.regexp_replace(plain, WHITE, " ")), 1, cap)


#: Marks of formatting and pictographs that a voice leaves out, and the most that it says.
UNSPOKEN, SPOKEN = "[*`#\u2705\U0001f4ca\U0001f916]|\u26a0\ufe0f", 800


def voice_text(text: Column) -> Column:
    """Text for a voice: no marks of formatting, no pictographs, at most ``SPOKEN`` characters."""
    return F.substring(F.regexp_replace(text, UNSPOKEN, ""), 1, SPOKEN)


def offline_reply(text: Column, run: dict[str, Column]) -> Column:
    """What is said about a run without a language model, by the intent of the message, from the run's figures alone.

    ``run`` has name, provenance, rmse_px, rmse_m, gsd_m, median_px, truth_px, degenerate, n_keypoints_a, n_keypoints_b, n_matches, n_inliers,
    total_ms. Without a run (a null rmse_px) there is nothing to report, and that is said.
    """
    px = lambda c, places=2: F.format_string(f"%.{places}f px", c)
    share = F.format_string("%.1f%%", 100 * run["n_inliers"] / F.greatest(run["n_matches"], F.lit(1)))
    ground = F.when(run["rmse_m"].isNotNull(), F.concat(F.lit(" ("), F.format_string("%.3f", run["rmse_m"]), F.lit(" m on the ground)"))).otherwise("")
    truth = F.when(run["truth_px"].isNotNull(), F.concat(F.lit(" Against the known map it is off by "), px(run["truth_px"]), F.lit("; that figure counts."))).otherwise("")
    weak = F.when(run["degenerate"], " The fit is degenerate: too few inliers to say much.").otherwise("")
    said = {
        "accuracy": F.concat(run["name"], F.lit(": residual "), px(run["rmse_px"], 3), ground, F.lit(", median "), px(run["median_px"]), F.lit("."), truth, weak),
        "matches": F.concat(F.format_number(run["n_keypoints_a"], 0), F.lit(" and "), F.format_number(run["n_keypoints_b"], 0), F.lit(" keypoints, "), run["n_matches"].cast("string"), F.lit(" matches, "), run["n_inliers"].cast("string"), F.lit(" inliers ("), share, F.lit(").")),
        "provenance": F.concat(F.lit("Provenance: "), F.coalesce(run["provenance"], F.lit("unknown")), F.lit(". Only pairs made by a known map have a true error.")),
    }
    other = F.when(run["truth_px"].isNotNull(), F.concat(F.lit(", true error "), px(run["truth_px"]))).otherwise("")
    out = F.concat(run["name"], F.lit(": "), run["n_inliers"].cast("string"), F.lit(" inliers of "), run["n_matches"].cast("string"), F.lit(" ("), share, F.lit("), residual "), px(run["rmse_px"], 3), other, F.lit(", "), F.format_string("%.0f ms", run["total_ms"]), F.lit("."))
    for name, reply in said.items():
        out = F.when(intent(text) == name, reply).otherwise(out)
    return F.when(run["rmse_px"].isNull(), "No run yet, so there are no figures to report.").otherwise(out)


def command(text: Column) -> Column:
    """The first command with a word of its own in an utterance of at most three words; null for none."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, f"^{WHITE}|{WHITE}$", "")), r"[.!?]+$", "")
    out = F.lit(None).cast("string")
    for name, words in reversed(COMMANDS.items()):
        out = F.when(plain.rlike(rf"(^|[^a-z0-9_])({'|'.join(words)})($|[^a-z0-9_])"), name).otherwise(out)
    return F.when(F.size(F.split(plain, WHITE)) <= 3, out)


def intent(text: Column) -> Column:
    """The first intent of which a word occurs anywhere in the lower-case text, else a summary; null text is empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("summary")
    for name, words in reversed(INTENTS.items()):
        out = F.when(low.rlike("|".join(words)), name).otherwise(out)
    return out
