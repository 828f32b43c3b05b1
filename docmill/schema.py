"""Record types and option sets of the engine."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field

from pyspark.sql import types as T

_s, _d, _l, _b = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


METADATA = _struct(content_type=_s, language=_s, last_updated=T.TimestampType(), tags=T.ArrayType(_s))
DOCUMENT = _struct(id=_s, content=_s, url=_s, title=_s, section=_s, metadata=METADATA)
ENTRY = _struct(id=_s, indexed_at=T.TimestampType(), vector=T.ArrayType(T.FloatType()), document=DOCUMENT)
CHUNK = _struct(content=_s, heading=_s, heading_context=_s, has_code=_b, position=_l, content_hash=_s, start_char=_l, end_char=_l)
CODE_BLOCK = _struct(code=_s, language=_s, context=_s, usage_example=_b, api_reference=_b)
PAGE_METADATA = _struct(url=_s, description=_s, keywords=_s, author=_s, language=_s, framework=_s, version=_s)
EXTRACTED = _struct(title=_s, markdown=_s, code_blocks=T.ArrayType(CODE_BLOCK), metadata=PAGE_METADATA, links=T.ArrayType(_s))

#: Kinds of documents.
CONTENT_TYPES = ("Documentation", "CodeExample", "Tutorial", "Reference", "BlogPost", "Other")
#: Names that the search tool accepts for kinds of documents; any other name sets no filter.
CONTENT_TYPE_NAMES = {"documentation": "Documentation", "code": "CodeExample", "api": "Reference"}


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 10
    min_score: float | None = None
    source_filter: str | None = None  # part of the url, case-sensitive
    content_type: str | None = None


@dataclass(frozen=True)
class Bm25Params:
    k1: float = 1.2
    b: float = 0.75
    idf_plus_one: bool = False  # ln(1 + ...), never negative


@dataclass(frozen=True)
class HybridOptions:
    base: SearchOptions = field(default_factory=SearchOptions)
    enabled: bool = True
    vector_weight: float = 0.7
    keyword_weight: float = 0.3
    bm25: Bm25Params = field(default_factory=Bm25Params)
    compat_heap: bool = False  # ranks that a heap bounded from the wrong end keeps


class Quantization(enum.Enum):
    NONE = "none"
    SCALAR_8BIT = "scalar_8bit"
    PRODUCT = "product"


@dataclass(frozen=True)
class FixedSize:
    size: int = 1000
    overlap: int = 200


@dataclass(frozen=True)
class Semantic:
    max_size: int = 1500
    min_size: int = 200


@dataclass(frozen=True)
class HeadingBased:
    max_size: int = 1500
    min_size: int = 200
    keep_small: bool = False  # a small section joins the next one instead of being dropped


@dataclass(frozen=True)
class CrawlChunks:
    max_tokens: int = 1500
    overlap: int = 200
    min_bytes: int = 100


ChunkStrategy = FixedSize | Semantic | HeadingBased | CrawlChunks


@dataclass(frozen=True)
class AnnParams:
    rows_per_cell: int = 500
    probes: int = 8
    cosine: bool = True
    sample_rows: int = 50_000
    seed: int = 17


class CrawlMode(enum.Enum):
    SINGLE = "single"
    SECTION = "section"
    FULL = "full"


class Focus(enum.Enum):
    API = "api"
    EXAMPLES = "examples"
    CHANGELOG = "changelog"
    QUICKSTART = "quickstart"
    ALL = "all"


@dataclass(frozen=True)
class UrlPatterns:
    include: tuple[str, ...] = ("/docs/", "/api/", "/guide/", "/reference/", "/tutorial/", "/manual/", "/changelog/", "/whatsnew/")
    exclude: tuple[str, ...] = ("/blog/", "/forum/", "/community/", "/discuss/", "/issues/", "/pull/", "/commits/")


@dataclass(frozen=True)
class CrawlConfig:
    start_url: str = ""
    mode: CrawlMode = CrawlMode.SINGLE
    focus: Focus = Focus.ALL  # accepted and kept; sets nothing apart
    max_pages: int = 100
    max_depth: int = 5
    concurrent_requests: int = 2
    delay_ms: int = 500
    user_agent: str = "docmill/0.1"
    allowed_domains: frozenset[str] = frozenset()
    patterns: UrlPatterns = field(default_factory=UrlPatterns)
