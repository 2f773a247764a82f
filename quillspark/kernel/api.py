"""The parser on single texts, for use without Spark."""

from __future__ import annotations

from pathlib import Path

from quillspark.kernel import config as _config
from quillspark.kernel.model import Node
from quillspark.kernel.parse import MAX_STAGE, parse
from quillspark.kernel.serialize import to_internal, to_text


class WikiConfig:
    """A site's grammar."""

    def __init__(self, site: _config.SiteConfig) -> None:
        self.site = site

    @classmethod
    def from_file(cls, path: str | Path) -> WikiConfig:
        return cls(_config.load(path))

    @classmethod
    def from_string(cls, text: str) -> WikiConfig:
        return cls(_config.from_string(text))


class WikiParser:
    """Empty input gives ``""``, ``{}`` and None, in the order of the methods."""

    def __init__(self, config: WikiConfig | None = None) -> None:
        self.site = config.site if config else None

    def parse_to_string(self, text: str, include: bool = False, max_stage: int = MAX_STAGE, page: str | None = None) -> str:
        """The round trip of the text."""
        return to_text(parse(text, self.site, include, page, max_stage)) if text else ""

    def parse_to_dict(self, text: str, include: bool = False, max_stage: int = MAX_STAGE, page: str | None = None) -> dict:
        return to_internal(parse(text, self.site, include, page, max_stage)) if text else {}

    def parse(self, text: str, include: bool = False, max_stage: int = MAX_STAGE, page: str | None = None) -> Node | None:
        return parse(text, self.site, include, page, max_stage) if text else None
