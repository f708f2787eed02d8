"""Words of the query language and the values they stand for."""

from __future__ import annotations

# Units of byte quantities.
BYTE_UNITS = {"b": 1} | {f"{p}b": 1000**k for k, p in enumerate("kmgtpe", 1)} | {f"{p}ib": 1024**k for k, p in enumerate("kmgtpe", 1)}

# Words before a quantity, whether it is the least, and whether it is included.
SIZE_WORDS = {
    "less than": (False, False),
    "more than": (True, False),
    "at most": (False, True),
    "at least": (True, True),
    "no more than": (False, True),
    "no less than": (True, True),
    "under": (False, False),
    "below": (False, False),
    "over": (True, False),
    "above": (True, False),
    "minimum": (True, True),
    "maximum": (False, True),
}

# Words for processor architectures.
ARCHITECTURES = {
    "amd64": "amd64",
    "x86_64": "amd64",
    "x64": "amd64",
    "arm64": "arm64",
    "aarch64": "arm64",
    "armhf": "armhf",
    "ppc64el": "ppc64el",
    "riscv64": "riscv64",
    "s390x": "s390x",
}

# Words for codecs.
CODECS = {
    "h264": "h264",
    "avc": "h264",
    "x264": "h264",
    "h265": "h265",
    "hevc": "h265",
    "x265": "h265",
    "av1": "av1",
    "vp9": "vp9",
    "theora": "theora",
    "xvid": "xvid",
}

# Words for providers.
PROVIDERS = {
    "archive": "internet_archive",
    "ia": "internet_archive",
    "internet_archive": "internet_archive",
    "internet-archive": "internet_archive",
    "academic": "academic_torrents",
    "academictorrents": "academic_torrents",
    "academic_torrents": "academic_torrents",
    "academic-torrents": "academic_torrents",
    "debian": "debian",
    "debian_official": "debian",
    "debian-official": "debian",
}

# Words for kinds of content.
CONTENT_KINDS = {
    "animation": "animation",
    "audio": "audio",
    "music": "audio",
    "book": "book",
    "ebook": "book",
    "dataset": "dataset",
    "disk-image": "disk_image",
    "disk_image": "disk_image",
    "image": "image",
    "movie": "video",
    "video": "video",
    "software": "software",
}

# Words for kinds of media.
MEDIA_KINDS = {
    "archive": "archive",
    "audio": "audio",
    "disk-image": "disk_image",
    "disk_image": "disk_image",
    "document": "document",
    "text": "document",
    "image": "image",
    "video": "video",
}

# Names of languages.
LANGUAGES = {
    "arabic": "ar",
    "chinese": "zh",
    "english": "en",
    "french": "fr",
    "german": "de",
    "hindi": "hi",
    "italian": "it",
    "japanese": "ja",
    "korean": "ko",
    "portuguese": "pt",
    "russian": "ru",
    "spanish": "es",
}

# Words for sort orders, as field and direction.
ORDERS = {
    "newest": ("date", "desc"),
    "newestfirst": ("date", "desc"),
    "datedesc": ("date", "desc"),
    "oldest": ("date", "asc"),
    "oldestfirst": ("date", "asc"),
    "dateasc": ("date", "asc"),
    "smallest": ("size", "asc"),
    "smallestfirst": ("size", "asc"),
    "sizeasc": ("size", "asc"),
    "largest": ("size", "desc"),
    "largestfirst": ("size", "desc"),
    "sizedesc": ("size", "desc"),
    "relevance": ("relevance", "desc"),
    "relevant": ("relevance", "desc"),
    "title": ("title", "asc"),
    "titleasc": ("title", "asc"),
    "titledesc": ("title", "desc"),
}
