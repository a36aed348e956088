"""Settings of an analysis, passed explicitly; defaults are those of the command line."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Kernel(Enum):
    LINEAR = "linear"
    QUADRATIC = "quadratic"
    CUBIC = "cubic"
    RBF = "rbf"


class SvmType(Enum):
    C_SVC = "c_svc"
    NU_SVC = "nu_svc"
    ONE_CLASS = "one_class"
    EPSILON_SVR = "epsilon_svr"
    NU_SVR = "nu_svr"


class WeightMode(Enum):
    """How log-odds weights treat features without positive or negative occurrences."""

    PREDICTOR = "predictor"
    ZERO = "zero"
    CONSTANT = "constant"
    PPV = "ppv"
    BIPPV = "bippv"


class Distance(Enum):
    CENTERS = "centers"
    BETWEEN = "between"


class CoreMode(Enum):
    NONE = "none"
    MOTIFS = "motifs"
    MOTIFS_STRONG = "motifs_strong"
    CONTINUOUS = "continuous"


#: Features around an occurrence, in their order in a vector.
LOCAL_FEATURES = ("nOcc", "GC", "DNT")


@dataclass(frozen=True)
class Settings:
    """gamma None is 1 / features. training_rows bounds what the driver or a task holds of a training set: machines of more
    labelled rows (of a motif, in hierarchical models) are trained on all of them by rounds over the table."""

    seed: int = 0
    automaton: bool = True
    validate: bool = True
    window_size: int = 500
    window_step: int = 100
    train_step: int = 250
    pair_cutoff: int = 219
    homo_pairs: bool = True
    hetero_pairs: bool = True
    pairs_can_overlap: bool = True
    distance: Distance = Distance.CENTERS
    kernel: Kernel = Kernel.LINEAR
    svm_type: SvmType = SvmType.EPSILON_SVR
    c0: float = 0.0
    cost: float = 1.0
    nu: float = 0.5
    p: float = 0.995
    gamma: float | None = None
    threshold: float = 0.0
    trees: int = 500
    depth: int = 0
    perceptron_rounds: int = 100_000
    weight_mode: WeightMode = WeightMode.PREDICTOR
    beta: float = 1e-8
    wanted_precision: float = -1.0
    background_order: int = 4
    core_mode: CoreMode = CoreMode.NONE
    core_max: bool = False
    local_features: tuple[str, ...] = LOCAL_FEATURES
    training_rows: int = 50_000

    def __post_init__(self) -> None:
        if not 0 < self.window_step < self.window_size:
            raise ValueError("a window's step must be over 0 and below its size")
        if not self.local_features or not set(self.local_features) <= set(LOCAL_FEATURES):
            raise ValueError(f"local features are of {LOCAL_FEATURES}")
