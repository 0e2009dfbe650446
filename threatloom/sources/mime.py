"""Raw mail to the nested messages table: the one parse in Python, in Arrow batches; everything after it is columns."""

from __future__ import annotations

import re
from email import policy
from email.errors import HeaderParseError
from email.header import decode_header, make_header
from email.parser import BytesParser
from email.utils import getaddresses

from pyspark.sql import DataFrame

from threatloom.functions.codecs import decode_entities
from threatloom.functions.markup import tokens
from threatloom.runtime import ship

MESSAGE = (
    "message_id string, subject string, date string, from_name string, from_domain string, from_all array<struct<name string, domain string>>, reply_domain string, rcpt_domains array<string>,"
    " list_unsubscribe string, text string, html string, html_parts array<string>, raw_text string, plain_only boolean, urls array<string>,"
    " parts array<struct<mime string, length bigint, width int, height int, multipart boolean, filename string, attached boolean, content binary>>, error string"
)
_URL = re.compile(r"https?://[^\s<>\"']+", re.I)
#: Top-level names that are reserved, which text links don't count under.
RESERVED_TLDS = {"example", "test", "invalid", "localhost"}


def _domain(pairs: list[tuple[str, str]]) -> str | None:
    for _, a in pairs:
        if "@" in a:
            return a.rpartition("@")[2].strip("<> .").lower() or None
    return None


def picture_size(data: bytes) -> tuple[int, int] | tuple[None, None]:
    """Width and height from the head of a PNG or GIF; (None, None) for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20]) & 0x7FFFFFFF, int.from_bytes(data[20:24]) & 0x7FFFFFFF
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    return None, None


def _decoded(value: str) -> str:
    """A header value with its RFC 2047 words decoded; as it is where they are malformed."""
    try:
        return str(make_header(decode_header(value)))
    except (HeaderParseError, LookupError, UnicodeError, ValueError):
        return value


def parse_message(name: str, raw: bytes, known_tld_only: bool = True) -> dict:
    """One mail as a row of MESSAGE. Malformed input never fails: what can't be read is null or empty, and `error` says why."""
    out: dict = {"message_id": name, "parts": [], "urls": [], "from_all": [], "rcpt_domains": [], "html_parts": [], "plain_only": False}
    try:
        m = BytesParser(policy=policy.compat32).parsebytes(raw or b"")
        head = lambda k: None if m[k] is None else str(m[k])
        # mailboxes are told apart before their names are decoded, since a decoded name may hold commas
        sender = [(_decoded(n), a) for n, a in getaddresses([head("From") or ""])]
        subject = None if head("Subject") is None else _decoded(head("Subject"))
        bodies, pages, plain, texts = [], [], True, 0
        for part in m.walk():
            kind, multi = part.get_content_type(), part.is_multipart()
            data = b"" if multi else part.get_payload(decode=True) or b""
            file = part.get_filename()
            width, height = picture_size(data)
            attached = (part.get_content_disposition() == "attachment") or (file is not None and not kind.startswith("text/"))
            out["parts"].append({"mime": kind, "length": len(data), "width": width, "height": height, "multipart": multi, "filename": file, "attached": attached, "content": data})
            if multi:
                continue
            plain &= kind == "text/plain" and not attached
            if kind in ("text/plain", "text/html") and not attached:
                text = data.decode(part.get_content_charset() or "utf-8", "replace")
                texts += 1
                bodies.append(re.sub(r"<[^>]*>", " ", text) if kind == "text/html" else text)
                if kind == "text/html":
                    pages.append(text)
        targets = (decode_entities(t.attrs["href"]).strip() for page in pages for t in tokens(page) if t.kind == "start" and "href" in t.attrs)
        links = [u for u in targets if _URL.match(u)]
        for u in _URL.findall("\n".join(bodies)):
            host = re.sub(r"^https?://([^/?#:]+).*", r"\1", u.rstrip("])}>,;.!?"), flags=re.I | re.S)
            if not (known_tld_only and host.rpartition(".")[2].lower() in RESERVED_TLDS):
                links.append(u.rstrip("])}>,;.!?"))
        lower = lambda s: s.translate({k: k + 32 for k in range(65, 91)})
        out |= {
            "subject": subject, "date": head("Date"), "from_name": sender[0][0] if sender else None, "from_domain": _domain(sender),
            "from_all": [{"name": n, "domain": _domain([(n, a)])} for n, a in sender],
            "reply_domain": _domain(getaddresses([head("Reply-To") or ""])), "rcpt_domains": [d for a in getaddresses([head("To") or ""]) if (d := _domain([a]))],
            "list_unsubscribe": head("List-Unsubscribe"), "text": lower("\n".join([subject or "", *bodies])), "html": "\n".join(pages), "html_parts": pages,
            "raw_text": raw.decode("utf-8", "replace"), "plain_only": plain and texts > 0, "urls": list(dict.fromkeys(links)),
        }
    except Exception as e:  # a mail that can't be parsed is a mail without content, and says why
        out["error"] = f"{type(e).__name__}: {e}"[:200]
    return out


def parse_messages(files: DataFrame, known_tld_only: bool = True) -> DataFrame:
    """files (path, content) -> MESSAGE."""
    import pandas as pd

    ship(files.sparkSession)
    names = [x.split()[0] for x in ("message_id subject date from_name from_domain from_all reply_domain rcpt_domains list_unsubscribe text html html_parts raw_text plain_only urls parts error").split()]

    def parse(batches):
        for pdf in batches:
            rows = [parse_message(p, c, known_tld_only) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(parse, MESSAGE)
