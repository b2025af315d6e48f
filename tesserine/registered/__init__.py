"""Modules of registered queries; importing them registers."""

from . import filters  # noqa: F401
from . import retrieval  # noqa: F401
from . import events  # noqa: F401
from . import structure  # noqa: F401
from . import inference  # noqa: F401
from . import discovery  # noqa: F401
from . import reactive  # noqa: F401
from . import maps  # noqa: F401
