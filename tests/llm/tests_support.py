def unsigned(value: int) -> int:
    """The signed long with the bits of an unsigned one."""
    return value - (1 << 64) if value >> 63 else value
