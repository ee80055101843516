from churnforge.functions import clean, features  # noqa: F401
