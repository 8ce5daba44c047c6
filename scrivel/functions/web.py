"""Signing, proxy addresses, and clean-up of CSS and HTML.

Signing and absolute addresses are built-in expressions. Resolving relative references and rewriting inside CSS and HTML
need a function for each match, so these are Arrow-batched functions on the standard library.
"""

import hashlib
import hmac
import html
import re
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import quote_plus, urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from scrivel.functions.batches import short_batches

KEY = b"scrivel-demo-key"
UNSAFE = {"applet", "canvas", "embed", "math", "script", "svg"}
SAFE_ATTRIBUTES = set(
    "abbr accesskey align alt as autocomplete charset checked class content contenteditable contextmenu dir for height hidden hreflang id"
    " lang media method name nowrap placeholder property rel spellcheck tabindex target title translate type value width".split()
)
SAFE_RELS = set("alternate archives author copyright first help icon index last license manifest next pingback prev publisher search stylesheet up".split()) | {"shortcut icon"}
SAFE_HTTP_EQUIV = {"date", "last-modified", "refresh", "content-language"}
CSS_URL = re.compile(r"""(?im)url\(['"]?(.+?)['"]?\)""")
BANNER = '<div style="position: sticky; top: 0">This page is shown through a proxy; scripts are off.</div>'


def hmac_hex(message: Column, key: bytes = KEY) -> Column:
    """HMAC-SHA-256 in lower-case hex, from two SHA-256."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in block).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def signed_address(url: Column, key: bytes = KEY) -> Column:
    """The proxy address of an absolute url; its fragment is neither signed nor encoded."""
    plain = F.substring_index(url, "#", 1)
    fragment = F.when(F.length(url) > F.length(plain) + 1, F.substring(url, F.length(plain) + 1, F.length(url))).otherwise("")
    return F.concat(F.lit("/proxy?url="), F.url_encode(plain), F.lit("&key="), hmac_hex(plain, key), fragment)


def signature_holds(url: Column, signature: Column, key: bytes = KEY) -> Column:
    return hmac_hex(url, key) == signature


def type_allowed(content_type: Column) -> Column:
    return content_type.rlike("html|css|image|plain|font")


def utf8_type(content_type: Column) -> Column:
    return F.regexp_replace(content_type, r"(?i)charset=[\w\d\- ]+;?", "charset=utf-8;")


def password_hash(password: Column, salt: Column) -> Column:
    return F.sha2(F.concat(password, salt).cast("binary"), 256)


def escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def human_size(n: Column) -> Column:
    out = F.format_string("%.2f GB", n / 2.0**30)
    for unit, size in (("MB", 2.0**20), ("KB", 2.0**10)):
        out = F.when(n < size * 1024, F.format_string(f"%.2f {unit}", n / size)).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)


# --- functions of one value ---------------------------------------------------------------------------------------


def address(base: str, raw: str, key: bytes = KEY) -> str | None:
    """The signed address that raw, found in a page at base, becomes; None if it must not be followed."""
    low = raw[:20].lower()
    if low.startswith("javascript:"):
        return None
    if low.startswith("data:"):
        kind, semicolon, _ = raw[5:].partition(";")
        return raw if semicolon and "image" in kind else None
    if low.startswith("#"):
        return raw
    try:
        url, fragment = urldefrag(urljoin(base, raw))
    except ValueError:
        return None
    signature = hmac.new(key, url.encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest()
    return f"/proxy?url={quote_plus(url)}&key={signature}" + (f"#{fragment}" if fragment else "")


def clean_css(base: str, css: str) -> str:
    """Rewrites url(...); what must not be followed is left as it is."""

    def put(m: re.Match) -> str:
        new = address(base, m[1])
        at = m.start(1) - m.start()
        return m[0] if new is None else m[0][:at] + new + m[0][at + len(m[1]) :]

    return CSS_URL.sub(put, css)


def _escape(s: str) -> str:
    return html.escape(s, quote=False).replace('"', "&#34;").replace("'", "&#39;")


def clean_attributes(base: str, attrs: list[tuple[str, str]]) -> str:
    out = ""
    for name, value in attrs:
        if name in SAFE_ATTRIBUTES:
            out += f' {name}="{_escape(value)}" '
        elif name in ("src", "href"):
            new = address(base, value)
            out += f' {name}="{new}" ' if new is not None else ""
        elif name == "action":
            out += ' action="/proxy" '
        elif name == "style":
            out += f' style="{_escape(clean_css(base, value))}" '
    return out


def clean_link(base: str, attrs: list[tuple[str, str]]) -> str:
    for name, value in attrs:
        if name == "rel" and value not in SAFE_RELS or (name, value) == ("as", "script"):
            return ""
    return f"<link{clean_attributes(base, attrs)}>"


def clean_meta(base: str, attrs: list[tuple[str, str]]) -> str:
    found = dict(attrs)
    kind = found.get("http-equiv", "").lower()
    if "charset" in found or "http-equiv" in found and kind not in SAFE_HTTP_EQUIV:
        return ""
    content = found.get("content", "")
    at = content.lower().find("url=")
    if kind == "refresh" and at >= 0:
        new = address(base, content[at + 4 :].strip("\"'"))
        return f'<meta http-equiv="refresh" content="{content[:at]}url={new}">' if new is not None else "<meta>"
    return "<meta" + (f' http-equiv="{kind}"' if kind else "") + clean_attributes(base, attrs) + ">"


class _Cleaner(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=False)
        self.base, self.out, self.unsafe, self.style = base, [], [], False

    def _tag(self, tag: str, attrs: list, closed: bool) -> None:
        if self.unsafe:
            return
        if tag in UNSAFE:
            if not closed:
                self.unsafe.append(tag)
            return
        attrs = [(k, v or "") for k, v in attrs]
        if tag == "base":
            self.base = dict(reversed(attrs)).get("href", self.base)
        elif tag == "link":
            self.out.append(clean_link(self.base, attrs))
        elif tag == "meta":
            self.out.append(clean_meta(self.base, attrs))
        elif tag != "noscript":
            self.style = tag == "style" and not closed
            self.out.append(f"<{tag}{clean_attributes(self.base, attrs)}" + ("/>" if closed else ">"))
            if tag == "form":
                url = urljoin(self.base, dict(reversed(attrs)).get("action", ""))
                signature = hmac.new(KEY, url.encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest()
                self.out.append(f'<input type="hidden" name="url" value="{_escape(url)}" /><input type="hidden" name="key" value="{signature}"/>')
            elif tag == "body":
                self.out.append(BANNER)

    def handle_starttag(self, tag, attrs):
        self._tag(tag, attrs, False)

    def handle_startendtag(self, tag, attrs):
        self._tag(tag, attrs, True)

    def handle_endtag(self, tag):
        if self.unsafe:
            if tag == self.unsafe[-1]:
                self.unsafe.pop()
            return
        if tag == "style":
            self.style = False
        if tag != "noscript":
            self.out.append(f"</{tag}>")

    def _text(self, s: str) -> None:
        if not self.unsafe:
            self.out.append(clean_css(self.base, s) if self.style else s)

    handle_data = _text

    def handle_entityref(self, name):
        self._text(f"&{name};")

    def handle_charref(self, name):
        self._text(f"&#{name};")

    def handle_decl(self, decl):
        self._text(f"<!{decl}>")


def clean_html(base: str, page: str) -> str:
    """A page without scripts and other unsafe elements, its addresses signed; comments go, noscript is unwrapped."""
    c = _Cleaner(base)
    c.feed(page)
    c.close()
    return "".join(c.out)


def _batched(fn: Callable[[str, str], str | None]):
    # whole pages: a worker holds a batch of them, as strings and cleaned
    short_batches(SparkSession.active())

    @F.pandas_udf("string")
    def run(base: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else fn(b or "", v) for b, v in zip(base, value)], dtype=object)

    return run


def proxy_address(base: Column, raw: Column) -> Column:
    return _batched(address)(base, raw)


def sanitize_css(base: Column, css: Column) -> Column:
    return _batched(clean_css)(base, css)


def sanitize_html(base: Column, page: Column) -> Column:
    return _batched(clean_html)(base, page)
