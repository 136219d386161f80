"""What a caller asks for: ids, tags and limits as typed, parsed on the driver into plain lists."""

from __future__ import annotations

import uuid

#: Ids and tags that one request may name, and rows that it may ask for.
MOST_IDS, MOST_TAGS, MOST_ROWS = 400, 30, 500


def parse_ids(raw: str | None, most: int = MOST_IDS) -> list[str]:
    """Comma-separated ids; what is no id is left out; the first ones up to the bound stay, repeats too."""
    out = []
    for part in (raw or "").split(","):
        try:
            out.append(str(uuid.UUID(part.strip())))
        except ValueError:
            continue
    return out[:most]


def parse_tags(raw: str | None, most: int = MOST_TAGS) -> list[str]:
    """Tags separated by commas or line breaks, without blanks and quotes around them, each once, in order."""
    bare = (part.strip() for part in (raw or "").replace("\n", ",").split(","))
    unquoted = (p[1:-1].strip() if len(p) > 1 and p[0] == p[-1] and p[0] in "'\"" else p for p in bare)
    return list(dict.fromkeys(p for p in unquoted if p not in ("", "'", '"')))[:most]


def clamp(wanted: int | None, default: int, most: int = MOST_ROWS) -> int:
    """A number of rows between 1 and the bound."""
    return max(1, min(default if wanted is None else wanted, most))


def pool_bound(wanted: int) -> int:
    """Rows of the random pool that a sample of the wanted size is drawn from."""
    return max(6 * wanted, 600)
