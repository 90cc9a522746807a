"""Small dimension tables: dialect rules, refused file types, and the words that explain why a paragraph stays as it is."""

from __future__ import annotations

#: name, pattern on a trimmed line, what it freezes, only within block quotes
DIALECT_RULES = (
    ("docusaurus-directive-fence", r"^:::", "line", False),
    ("hugo-shortcode-block", r"^\{{2}[%<].*[>%]\}{2}$", "line", False),
    ("github-alert-marker", r"^\[!(CAUTION|WARNING|NOTE|IMPORTANT|TIP)\]", "line", True),
    ("math-block-fence", r"^\$\$$", "any", False),
    ("mdx-block-expr", r"^\{[^{}]*\}$", "any", False),
    ("mdx-import-export", r"^(import|export)\b", "all", False),
    ("toml-front-matter", r"^\+\+\+$", "any", False),
)

MARKDOWN = ("md", "mdx", "markdown")
REFUSED = tuple(
    "7z bash bin bz2 c cc cfg cjs conf cpp css csv exe fish gif go gz h hpp htm html ico ini java jpeg jpg js json jsx kt less "
    "lock mjs mod mp3 mp4 otf pdf png proto py rb rs scss sh sql sum svg swift tar toml ts tsv tsx ttf woff woff2 xml yaml yml zip zsh".split()
)

#: code: (what was found, what to do about it)
REASONS = {
    "link-ref-def-shape": ("it holds something shaped like a link definition, a label in brackets and a colon", "Put it into a fenced block, or lay the lines out by hand; escaping the bracket changes nothing."),
    "link-ref-def-neighbor": ("a link definition stands right above, and could reach into it", "Leave a blank line after the definition, or lay the lines out by hand."),
    "possible-link-ref-def": ("joining its lines could complete an open bracket or link target", "Put the bracketed text into a fenced block, or lay the lines out by hand."),
    "raw-html-decl-opener": ("an HTML declaration or instruction opens outside code", "Put it into a fenced block, or lay the lines out by hand."),
    "unterminated-tag": ("it begins with a tag that a later line closes", "Close the tag on its own line, or lay the lines out by hand."),
    "table-adjacency": ("a table ends right above", "Leave a blank line below the table."),
    "deep-nesting": ("it is more than two lists or quotes deep", "Nest it less deeply, or lay the lines out by hand."),
    "control-bytes": ("it holds a control character", "Remove the character."),
    "degenerate-blank": ("one of its lines shows nothing", "Remove the invisible characters."),
    "hidden-line-gap": ("definitions stand between its own lines", "Leave a blank line between definitions and prose."),
    "duplicate-def-line": ("one of its lines is also part of a repeated definition", "Remove or rename the repeated definition."),
    "dialect-block": ("it is not prose but a construct of a site generator", "Nothing: it is never reflowed."),
}
