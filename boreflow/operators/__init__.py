"""DataFrame operators. All windows partition by ``well`` and order by ``ds``."""
