"""Contracts of events and results. Amounts are unsigned 256-bit integers in decimal text."""

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "strings": T.ArrayType(T.StringType())}


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split(":") for part in spec.split())])


_COMMON = "eventId:string blockNumber:long blockTimestamp:long transactionHash:string logIndex:int pairAddress:string token0:string token1:string token0Symbol:string token1Symbol:string"
SWAP = _schema(f"{_COMMON} sender:string recipient:string amount0In:string amount1In:string amount0Out:string amount1Out:string price:double volumeUSD:double gasUsed:long gasPrice:string eventTimestamp:long")
MINT = _schema(f"{_COMMON} sender:string amount0:string amount1:string eventTimestamp:long")
BURN = _schema(f"{_COMMON} sender:string recipient:string amount0:string amount1:string eventTimestamp:long")
TRANSFER = _schema(f"{_COMMON} from:string to:string value:string eventTimestamp:long")
EVENTS = {"Swap": SWAP, "Mint": MINT, "Burn": BURN, "Transfer": TRANSFER}
#: Fields that the wire format marks as optional.
OPTIONAL = frozenset(["token0Symbol", "token1Symbol", "volumeUSD"])
_WINDOW = "windowId:string windowStart:long windowEnd:long pairAddress:string token0Symbol:string token1Symbol:string"
TRADING = _schema(f"{_WINDOW} twap:double openPrice:double closePrice:double highPrice:double lowPrice:double priceVolatility:double totalVolume0:string totalVolume1:string volumeUSD:double swapCount:int uniqueTraders:int largestSwapValue:string largestSwapAddress:string totalGasUsed:long averageGasPrice:string arbitrageCount:int repeatedTraders:strings processedAt:long")
LIQUIDITY = _schema(f"{_WINDOW} mintCount:int burnCount:int totalMintAmount0:string totalMintAmount1:string totalBurnAmount0:string totalBurnAmount1:string netLiquidityChange0:string netLiquidityChange1:string totalLpTokensMinted:string totalLpTokensBurned:string netLpTokenChange:string transferCount:int uniqueMintProviders:int uniqueBurnProviders:int uniqueProviders:int churnedProviders:int processedAt:long")
ALERT = _schema("alertId:string alertType:string windowStart:long windowEnd:long pairAddress:string token0Symbol:string token1Symbol:string blockNumber:long attackerAddress:string victimAddresses:strings estimatedProfitUSD:double involvedSwapCount:int involvedEventCount:int severity:string description:string involvedTransactions:strings detectedAt:long")
TREND = _schema(f"{_WINDOW} avgPrice:double openPrice:double closePrice:double priceChangePercent:double volumeUSD:double swapCount:int uniqueTraders:int volatility:double trend:string processedAt:long")
RESULTS = {"trading-analytics": TRADING, "liquidity-analytics": LIQUIDITY, "pattern-analytics": ALERT, "market-trends": TREND}
