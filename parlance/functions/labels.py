"""Classifiers of labels, names and window titles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label spellings, junk characters and outcome names.
YOU, SYSTEM_AUDIO, NEW_SPEAKER = "You", "System Audio", "New speaker"
NAME_JUNK = "….\"'`,:;!? "
CHANGING = ("fill", "spelling", "replace")


def _blank(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit("")) == ""


def live_label(live: Column, speaker: Column) -> Column:
    """The live label, else the speaker."""
    return F.coalesce(F.nullif(live, F.lit("")), speaker)


def diarizable(source: Column, live: Column) -> Column:
    """Lines of others, judged by their live label."""
    return (source != "mic") & ~F.coalesce(live, F.lit("")).isin(YOU, SYSTEM_AUDIO)


def hint_name(label: Column) -> Column:
    """The name in 'Person N (Name)', else empty."""
    return F.regexp_extract(label, r"^Person \d+ \((.+)\)$", 1)


def status_rank(status: Column) -> Column:
    """live 0, pending 1, final (empty) 2, removed 3."""
    return F.when(status == "live", 0).when(status == "pending", 1).when(status == "removed", 3).otherwise(2).cast("long")


def is_provisional(label: Column) -> Column:
    return label.startswith(NEW_SPEAKER) | label.endswith("?") | label.endswith("?)")


def is_room(name: Column) -> Column:
    """Some whole run of letters is 'room' or 'rooms'."""
    return F.arrays_overlap(F.split(F.lower(name), r"[^\p{L}]+"), F.array(F.lit("room"), F.lit("rooms")))


def given_name(label: Column) -> Column:
    """The name a user gave, else empty: no blank, You, Person ..., provisional or room label."""
    trimmed = F.trim(label)
    own = _blank(trimmed) | (trimmed == YOU) | trimmed.startswith("Person ") | is_provisional(trimmed) | is_room(trimmed)
    return F.when(own, F.lit("")).otherwise(trimmed)


def speaker_name(label: Column) -> Column:
    """The person a label names: the given name, or the hint's unless it is a room or doubtful."""
    hint = hint_name(label)
    fine = (hint != "") & ~hint.endswith("?") & ~is_room(hint)
    return F.when(given_name(label) != "", given_name(label)).when(fine, hint).otherwise(F.lit(""))


def is_unnamed(label: Column) -> Column:
    hint = hint_name(label)
    return label.rlike(r"^Person \d+$") | ((hint != "") & is_room(hint))


def label_kind(label: Column) -> Column:
    """mic, given, named, room or placeholder; the order of the tests matters."""
    trimmed = F.trim(label)
    inner = F.trim(F.regexp_extract(trimmed, r"^Person \d+(?: \((.*)\))?$", 1))
    person = trimmed.rlike(r"^Person \d+(?: \((.*)\))?$")
    return (
        F.when(trimmed == YOU, "mic")
        .when(given_name(trimmed) != "", "given")
        .when(person & (inner != "") & ~inner.endswith("?"), "named")
        .when(person, "placeholder")
        .when(is_room(trimmed), "room")
        .otherwise("placeholder")
    )


def label_person(label: Column) -> Column:
    """The name that label_kind's label carries."""
    trimmed, kind = F.trim(label), label_kind(label)
    inner = F.trim(F.regexp_extract(trimmed, r"^Person \d+(?: \((.*)\))?$", 1))
    return F.when(kind.isin("given", "room"), trimmed).when(kind == "named", inner).otherwise(F.lit(""))


def without_headcount(name: Column) -> Column:
    """Room names lose a final '(8)'; other names stay."""
    return F.when(is_room(name), F.regexp_replace(name, r"\s*\(\d+\)$", "")).otherwise(name)


def normalized_name(name: Column) -> Column:
    """Lower case, without spaces at the ends and junk after it."""
    return F.lower(F.trim(F.regexp_replace(F.trim(name), "[" + NAME_JUNK.replace('"', '\\"') + "]+$", "")))


def same_name(a: Column, b: Column) -> Column:
    """Two names (normalized) are one person's: equal, one begins the other (4 bytes at least), or an edit or two apart."""
    la, lb = F.octet_length(a), F.octet_length(b)
    short, long = F.least(la, lb), F.greatest(la, lb)
    prefix = F.when(la <= lb, b.startswith(a)).otherwise(a.startswith(b))
    near = F.levenshtein(a, b) <= F.greatest(F.lit(1), F.floor(long / 8))
    return (a == b) | ((short >= 4) & prefix) | ((short >= 5) & near)


def same_name_loose(a: Column, b: Column) -> Column:
    """As same_name, or equal but for case, or one is the other's first name alone."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    single = ((F.size(F.split(x, r"\s+")) == 1) | (F.size(F.split(y, r"\s+")) == 1)) & (F.split(x, r"\s+")[0] == F.split(y, r"\s+")[0])
    return (x == y) | same_name(normalized_name(a), normalized_name(b)) | ((x != "") & (y != "") & single)


def outcome(kind: Column, current: Column, proposed: Column) -> Column:
    """What applying a proposed name does with a label."""
    return (
        F.when(kind == "mic", "kept-mic")
        .when(kind == "room", "kept-room")
        .when((kind == "given") & same_name_loose(current, proposed), "agree")
        .when(kind == "given", "kept-given")
        .when((kind == "named") & (F.lower(current) == F.lower(proposed)), "agree")
        .when((kind == "named") & same_name_loose(current, proposed), "spelling")
        .when((kind == "named") & is_room(proposed) & ~is_room(current), "kept-room")
        .when(kind == "named", "replace")
        .otherwise("fill")
    )


def changes(found: Column) -> Column:
    return found.isin(*CHANGING)


def platform(title: Column) -> Column:
    """The meeting platform that a window title names."""
    low = F.lower(title)
    return (
        F.when(low.contains("microsoft teams"), "teams")
        .when(low.contains("meet -") | low.contains("meet.google.com"), "meet")
        .when(low.contains("zoom"), "zoom")
        .when(low.contains("webex"), "webex")
        .when(low.contains("slack"), "slack")
        .otherwise("unknown")
    )


def window_verdict(owner: Column, title: Column, window_id: Column) -> Column:
    """accepted, or why a window is not: other, untitled, chat, generic, invalid."""
    return (
        F.when(~F.lower(owner).contains("teams"), "other")
        .when(title == "", "untitled")
        .when(title.startswith("Chat |"), "chat")
        .when(title == "Window", "generic")
        .when(window_id < 0, "invalid")
        .otherwise("accepted")
    )


def share_bucket(share: Column) -> Column:
    return F.when(share >= 0.95, ">=0.95").when(share >= 0.9, ">=0.9").when(share >= 0.8, ">=0.8").when(share >= 0.7, ">=0.7").otherwise("<0.7")


def turn_bucket(words: Column) -> Column:
    """Turn lengths in words: 1-3, 4-15, 16-60, 61+."""
    return F.when(words <= 3, "1-3").when(words <= 15, "4-15").when(words <= 60, "16-60").otherwise("61+")


def default_title(at: Column) -> Column:
    return F.concat(F.lit("Meeting "), F.date_format(at, "yyyy-MM-dd HH:mm"))


def person_label(number: Column, name: Column) -> Column:
    return F.when(_blank(name), F.format_string("Person %d", number)).otherwise(F.format_string("Person %d (%s)", number, name))


def snap_limit(a: Column, b: Column) -> Column:
    """Edits allowed between a read name and an invitee: at most 2, and a fifth of the longer."""
    return F.least(F.lit(2), F.floor(F.greatest(F.length(a), F.length(b)) / 5))
