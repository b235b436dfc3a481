"""DataFrame operators over the flat tables of `boxlake.schemas`."""
