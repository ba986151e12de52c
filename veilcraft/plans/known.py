"""Known answers for the tokens of short names: computed by the tests' own implementation of the cipher, not by this library.

The key is that of the sample tables.
"""

# fixed values: token of each nation name in namespace "nation"
NATION_TOKENS = {
    "NATION_0": "nation:bmoaeBB7HZ1Zbkmrg9a3pn3UA24Yz2By",
    "NATION_1": "nation:0Pktk_oXpTWxQqPoaOqT9f3H_GsgYp2P",
    "NATION_10": "nation:SzcHg-_JvzR2e2ODp_s41QubS2bvGEPrqg",
    "NATION_11": "nation:CDIiVhe-yvdnPZWoRKFbGgvnuD4Ovc5qFg",
    "NATION_12": "nation:7z9whgFkEk2bP-5ZArnJCmlI92Ye_M8kwA",
    "NATION_13": "nation:k3pEgdxqiWmS_Ptl-pqfz7yhQcFfZ4-vKg",
    "NATION_14": "nation:GvyTNHDmE9XDfzYl4bZ-prlI-L417l__rg",
    "NATION_15": "nation:WmqC9O-B5VFSNhtoI0j5Ti50lBjPcRPW7Q",
    "NATION_16": "nation:y-Qghz-kOHgPMLl4I39PMS2KYC02BPpn3A",
    "NATION_17": "nation:QetCyUXWLbUuZla95b4eeIZFjc7BgxjJOg",
    "NATION_18": "nation:XCz9HNdlleKvvv_mAxSITNcIsqOpyHES0g",
    "NATION_19": "nation:vv5DxGr-56q_vf9pkBQmV4HqBkKK7DP-bQ",
    "NATION_2": "nation:eeeuqzfPgrYENCb7cKFis1mC--DiZ05J",
    "NATION_20": "nation:Sz4o7xJcQDJ6s-MBDBkPAL30UqhYhaoe_A",
    "NATION_21": "nation:lQiG-jffg0U7LiWtUJ1jCdahnj3-6adkpg",
    "NATION_22": "nation:DLl2vtrT7MvjeGx4bVqur67TLiS4oL1xRA",
    "NATION_23": "nation:4ANDGfKs1ImtpBeTzai55z1n3lTaerxInQ",
    "NATION_24": "nation:RlLArZmBY8LNV5pdKir4ZY4Nfa4nBC6KJA",
    "NATION_3": "nation:Hm3XXkKlaHvXKvrHuRdHCQ6Rmt4l5lDf",
    "NATION_4": "nation:cWTEfnvo-xA3j3KjlpZuP33nJdEA0Xnm",
    "NATION_5": "nation:Wdj6Padz8uS3XGBRwjWHSPuh3zasiHmK",
    "NATION_6": "nation:vAKgAgPu2zuktB0Fx6iyTut6eZ-dHebD",
    "NATION_7": "nation:XmgHoWj95m6cKVNoVL4C5uQoMdI_c66b",
    "NATION_8": "nation:3SQaitcrJCWRVflwo8Nrj0IYrQKiVaJl",
    "NATION_9": "nation:Ds6MXNJwZrnSF1bK1z4awLMy5zy-TCom",
}
# fixed values: the first bytes (64 characters) and the last ones of tokens of region names repeated to a size, in namespace "region"
REGION_TOKENS = {
    ("AFRICA", 16): ("region:zYOBOHMW6iEWdp1QNGgPk4CLOPlRA4dbfe-lSZ85vXs", "lSZ85vXs"),
    ("AFRICA", 17): ("region:XkkW31MpPiKvfyP8BFNVBsbiq1UxPz-EIi3dvGBJnztF", "vGBJnztF"),
    ("AFRICA", 160): ("region:e1EKrA8aU5FO5RVPN198G2uG20dEb0FgzyO9TRkM_Adz9WNSC5LAG9Qyy", "MAAWV-yM"),
    ("AFRICA", 161): ("region:H9l8fO0l_OzqCXiwz4WsZAYhbUlUXgWhwjTvWDN7YNhWoha2MZRNdwi6E", "bYLxFCKn"),
    ("AMERICA", 16): ("region:YvTMr6uTmivoK7cScQCAbJfXmw4i7ykizqhStTip0hk", "StTip0hk"),
    ("AMERICA", 17): ("region:0JnmzpWxmBDlpKYNpVGPNFeX90E_qh8iABka7UmqbWLS", "7UmqbWLS"),
    ("AMERICA", 160): ("region:DD63BSgk2Kz-vR_Nm9yUmwnvtFtb0GcnQ0fxA2HGf-1NlGhzOmkagEPX9", "2AwEAfvw"),
    ("AMERICA", 161): ("region:skHnB6XHYEgnUG9D_pN-Iw1EEogPNjJn8-R5VOd_361HhzrqsHYn6jCi8", "GDG21arD"),
    ("ASIA", 16): ("region:iO2SlTcslbC0ts82AkgBNb_I9f8m22IKwFT4Vvn32Ds", "4Vvn32Ds"),
    ("ASIA", 17): ("region:wsQZKNT-i4pDWYEKhEC5WpjTog8RDXa4sT0Eu-Ws_Xxl", "u-Ws_Xxl"),
    ("ASIA", 160): ("region:UdOoMK09gRsvVMd6UwY16C7CfoGcjr2gjROob6qpn6XRfqF8SZP0K67jI", "xEd_76Ts"),
    ("ASIA", 161): ("region:UdOoMK09gRsvVMd6UwY16C7CfoGcjr2gjROob6qpn6XRfqF8SZP0K67jI", "xEd_76Ts"),
    ("EUROPE", 16): ("region:7QS8_WDjhwDzVJYbFw8WQ1AN2H7fGKaAT7Wg7OIHy9Y", "g7OIHy9Y"),
    ("EUROPE", 17): ("region:BavEcaoI5CVHAo6l_ixUxkn6pdErfzhcozbHZQ1Cr9li", "ZQ1Cr9li"),
    ("EUROPE", 160): ("region:oS73aGeebeq9gz6Sj7BkymkyNAGFTrXfsLFxYxoyRvlrZ6AmoPOnm7uDN", "fhc4GXXw"),
    ("EUROPE", 161): ("region:42DzD180iEXSC0nbDHsrEHTHuBYbzCJQz7vfX-QuCmcykmrDVK6Bnm59_", "Tx_weFYN"),
    ("MIDDLE EAST", 16): ("region:P7CGGjzJ2iMcdXSo3s_F9DiTMm0GPKxffvs9h5YtrKo", "9h5YtrKo"),
    ("MIDDLE EAST", 17): ("region:PmssBIsyLUSJzOWZ6rSJmLF1hGL86PznZcJv-nY0INx4", "-nY0INx4"),
    ("MIDDLE EAST", 160): ("region:Z4HKQCWTlMEO2L17V7mrGv9vWYxhw-GqvrHxx_KM8P5F3MsPR9EPaQA61", "J5vfzSYs"),
    ("MIDDLE EAST", 161): ("region:tMiRycHSLj3DwkRxXZ6KHtUUgdkV2obfZ95khzL1kxbBrSNNY_sVfZHsz", "iERHJk5k"),
}
