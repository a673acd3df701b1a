"""Built-in parsers for ``extract``: small per-document helpers run inside tasks.

``HtmlParser`` turns a web page into Markdown and typed blocks with the
standard-library tokenizer.  It tolerates messy markup: unclosed <p>/<li>,
scripts containing '</p>', comments.  Block rules:

* block elements (p, h1-h6, li, title, footer, blockquote, pre, div, td/th,
  figcaption, dt/dd) start a new block when they open or close;
* script, style, nav, noscript, template and svg content is skipped;
* text is white-space collapsed; <br> becomes a line break inside the block;
* <img src alt> is an image block (caption = alt);
* type: h1-h6 -> text with text_level; li -> list; pre -> code;
  title -> title; footer -> footer; <table> content -> one table block;
  otherwise text.
"""
from __future__ import annotations

import re
from html.parser import HTMLParser as _Tokenizer

SKIP = {"script", "style", "nav", "noscript", "template", "svg"}
BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "title", "footer", "blockquote", "pre", "div",
         "td", "th", "figcaption", "dt", "dd", "article", "section", "header", "main", "ul", "ol", "body",
         "table", "tr"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
_WS = re.compile(r"[ \t\n\r\f\v]+")


class _Collector(_Tokenizer):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.stack: list[str] = []
        self.skip_depth = 0
        self.buf: list[str] = []
        self.table_depth = 0
        self.table_buf: list[str] = []

    # -- helpers ------------------------------------------------------------
    def _kind(self):
        for tag in reversed(self.stack):
            if tag in HEADINGS:
                return "text", HEADINGS[tag]
            if tag == "li":
                return "list", None
            if tag == "pre":
                return "code", None
            if tag == "title":
                return "title", None
            if tag == "footer":
                return "footer", None
        return "text", None

    def _flush(self):
        if not self.buf:
            return
        raw = "".join(self.buf)
        self.buf = []
        lines = [_WS.sub(" ", x).strip() for x in raw.split("\n")]
        text = "\n".join(x for x in lines if x)
        if not text:
            return
        typ, level = self._kind()
        self.blocks.append({"type": typ, "text": text, "text_level": level, "page_idx": 0})

    # -- tokenizer callbacks ------------------------------------------------
    def handle_starttag(self, tag, attrs):
        if tag in SKIP:
            self.skip_depth += 1
            self.stack.append(tag)
            return
        if self.skip_depth:
            self.stack.append(tag)
            return
        if tag == "table":
            self._flush()
            self.table_depth += 1
            self.table_buf.append("<table>")
            self.stack.append(tag)
            return
        if self.table_depth:
            if tag in ("tr", "td", "th"):
                self.table_buf.append(f"<{tag}>")
            self.stack.append(tag)
            return
        if tag == "br":
            self.buf.append("\n")
            return
        if tag == "img":
            a = dict(attrs)
            self._flush()
            alt = (a.get("alt") or "").strip()
            self.blocks.append({"type": "image", "img_path": a.get("src") or "",
                                "img_caption": [alt] if alt else [], "page_idx": 0})
            return
        if tag in BLOCK:
            self._flush()
            # an unclosed <p>/<li> ends where the next sibling starts
            if tag in ("p", "li") and self.stack and self.stack[-1] == tag:
                self.stack.pop()
        if tag not in ("meta", "link", "input", "hr", "wbr", "source", "area", "base", "col", "embed"):
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return  # stray end tag (e.g. '</p>' with nothing open)
        if self.skip_depth and tag in SKIP:
            while self.stack:
                t = self.stack.pop()
                if t == tag:
                    break
            self.skip_depth = max(0, self.skip_depth - 1)
            return
        if self.skip_depth:
            while self.stack and self.stack.pop() != tag:
                pass
            return
        if tag == "table" and self.table_depth:
            self.table_buf.append("</table>")
            self.table_depth -= 1
            if not self.table_depth:
                html = "".join(self.table_buf)
                self.table_buf = []
                self.blocks.append({"type": "table", "text": html, "page_idx": 0, "table_caption": []})
        elif self.table_depth and tag in ("tr", "td", "th"):
            self.table_buf.append(f"</{tag}>")
        elif tag in BLOCK:
            self._flush()
        while self.stack:
            if self.stack.pop() == tag:
                break

    def handle_data(self, data):
        if self.skip_depth:
            return
        if self.table_depth:
            self.table_buf.append(data.replace("<", "&lt;"))
            return
        self.buf.append(data)

    def close(self):
        super().close()
        self._flush()


def blocks_to_markdown(blocks: list[dict]) -> str:
    out = []
    for b in blocks:
        t = b.get("type")
        if t == "image":
            cap = " ".join(b.get("img_caption") or [])
            out.append(f"![{cap}]({b.get('img_path') or ''})")
        elif t == "table":
            out.append(b.get("text") or "")
        elif t == "list":
            out.append("- " + (b.get("text") or ""))
        elif t == "code":
            out.append("```\n" + (b.get("text") or "") + "\n```")
        elif t == "title" or b.get("text_level"):
            out.append("#" * (b.get("text_level") or 1) + " " + (b.get("text") or ""))
        else:
            out.append(b.get("text") or "")
    return "\n\n".join(out)


class HtmlParser:
    """HTML page -> (markdown, blocks).  Pages have no pagination: page_idx 0."""

    def open(self):
        pass

    def parse(self, content, options):
        if content is None:
            raise ValueError("empty document")
        c = _Collector()
        c.feed(content)
        c.close()
        blocks = c.blocks
        if options.get("table") is False:
            blocks = [b for b in blocks if b["type"] != "table"]
        return blocks_to_markdown(blocks), blocks
