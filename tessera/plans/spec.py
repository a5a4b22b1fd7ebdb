"""Static description of an array: name, axes, dtype, block shape, extent and flags."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

#: Spark type of each logical dtype; unsigned types use the next wider signed one.
SPARK_TYPE = {
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "int32": "int", "int64": "bigint",
    "float32": "float", "float64": "double", "bool": "boolean",
}
ITEM_BYTES = {"uint8": 1, "uint16": 2, "uint32": 4, "uint64": 8, "int32": 4, "int64": 8, "float32": 4, "float64": 8, "bool": 1}


@dataclass(frozen=True)
class ArraySpec:
    """Everything about an array but its cells. extent None: unbounded."""

    name: str
    ndim: int
    dtype: str
    block_shape: tuple[int, ...]
    extent: tuple[int, ...] | None = None
    delete_empty: bool = False
    compressed: bool = False
    minmax: bool = False
    coo: bool = False

    def __post_init__(self):
        if self.dtype not in SPARK_TYPE:
            raise ValueError(f"unknown dtype {self.dtype}")
        if len(self.block_shape) != self.ndim or min(self.block_shape) < 1:
            raise ValueError("block shape must have one positive side an axis")
        if self.extent is not None and len(self.extent) != self.ndim:
            raise ValueError("extent must have one side an axis")

    @property
    def coords(self) -> list[str]:
        return [f"x{i}" for i in range(self.ndim)]

    @property
    def blocks(self) -> list[str]:
        return [f"b{i}" for i in range(self.ndim)]

    @property
    def value_type(self) -> str:
        return SPARK_TYPE[self.dtype]

    @property
    def block_cells(self) -> int:
        n = 1
        for s in self.block_shape:
            n *= s
        return n

    def with_(self, **changes) -> "ArraySpec":
        return replace(self, **changes)

    def as_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> "ArraySpec":
        return ArraySpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})
