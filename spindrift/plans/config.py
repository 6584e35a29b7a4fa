"""Names of methods and reductions as configurations give them."""

from __future__ import annotations

# fixed values: the methods, and other names for them
METHODS = ("clip", "dino", "siglip")
ALIASES = {"dinov2": "dino", "dino_v2": "dino", "siglip2": "siglip", "openclip": "clip"}
REDUCTIONS = ("pca", "umap", "tsne")


def parse_methods(text: str, known: tuple[str, ...] = METHODS) -> list[str]:
    """A comma list of names or "all", folded by alias, in order of first use; unknown names are an error."""
    out: list[str] = []
    for raw in text.split(","):
        name = raw.strip().lower()
        if not name:
            continue
        for one in known if name == "all" else [ALIASES.get(name, name)]:
            if one not in known:
                raise ValueError(f"unknown method {raw.strip()!r}")
            if one not in out:
                out.append(one)
    return out


def cache_name(method: str, reduction: str) -> str:
    return f"{parse_methods(method)[0]}__{reduction.strip().lower()}"
