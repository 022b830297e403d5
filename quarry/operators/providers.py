"""Which language model or embedder a run uses: the first provider whose key the environment has.

No client is part of this package: a provider is a function that the caller
registers and that takes the key and gives a callable.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

#: Environment variables that hold keys, in order of precedence.
MODEL_KEYS = {"openrouter": "OPENROUTER_API_KEY", "anthropic": "ANTHROPIC_API_KEY"}


def chosen(keys: Mapping[str, str] | None = None, environment: Mapping[str, str] | None = None) -> str | None:
    """Name of the first provider whose key is set, None without any."""
    env = os.environ if environment is None else environment
    return next((name for name, variable in (keys or MODEL_KEYS).items() if env.get(variable)), None)


def client(makers: Mapping[str, Callable[[str], Callable]], keys: Mapping[str, str] | None = None, environment: Mapping[str, str] | None = None) -> Callable | None:
    """The chosen provider's callable; None without a key, an error where no maker is registered for it."""
    env = os.environ if environment is None else environment
    name = chosen(keys, env)
    if name is None:
        return None
    if name not in makers:
        raise RuntimeError(f"no maker registered for {name}")
    return makers[name](env[(keys or MODEL_KEYS)[name]])
