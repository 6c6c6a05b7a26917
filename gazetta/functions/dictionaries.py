"""Words of notices' types and trades: fixed values, in the order in which they are tried."""

from __future__ import annotations

#: Trades and their words (fixed values); the trade with the most words in the text counts, the first of equals.
TRADES = {
    "建筑工程": (
        "建筑", "施工", "装修", "装饰", "钢结构", "幕墙", "消防", "电梯", "空调", "水电", "市政", "园林", "公路", "桥梁", "隧道", "地基", "防水", "防腐", "拆迁", "加固", "监理", "造价", "设计", "土建",
        "砼", "钢筋", "灌注", "管网", "道排", "绿化", "路灯", "外墙", "内装", "改造",
    ),
    "信息技术": (
        "软件", "系统", "网络", "信息化", "智能化", "安防", "监控", "会议", "广播", "音响", "大屏", "显示", "存储", "服务器", "数据", "云", "安全", "等保", "集成", "运维", "IT", "计算机", "数据库", "OA",
        "ERP", "智慧", "数字化", "物联网", "5G", "光纤", "带宽",
    ),
    "物资采购": (
        "设备", "机械", "车辆", "医疗", "教学", "实验", "科研", "办公", "家具", "厨房", "家电", "LED", "灯具", "电梯", "泵", "阀", "仪表", "耗材", "配件", "工具", "劳保", "服装", "面料",
    ),
    "服务类": (
        "物业", "保洁", "保安", "绿化", "餐饮", "酒店", "旅游", "咨询", "代理", "招标", "评估", "审计", "法律", "会计", "培训", "印刷", "租赁", "物流", "快递", "人力资源", "外包",
    ),
    "弱电智能化": (
        "监控", "门禁", "考勤", "巡更", "报警", "楼宇对讲", "停车场", "道闸", "人脸识别", "车牌识别", "视频监控", "综合布线", "有限电视", "广播系统", "会议系统", "大屏", "拼接屏", "信息发布",
    ),
}
#: Types of projects: name, words that speak for the type, words that rule it out (fixed values).
PROJECT_TYPES = [
    (
        "智能化",
        ("智能", "智慧", "智能化", "AI", "物联网", "楼宇自控", "弱电", "安防", "信息化", "智慧城市", "智慧社区", "智慧政务", "智慧楼宇", "智慧园区", "智慧医疗", "智慧教育", "智慧交通", "数据中心", "云计算",
         "大数据平台", "视频监控", "门禁", "停车场系统", "会议系统", "广播系统", "机房"),
        ("改造", "维修", "维护", "保养", "检修", "装修", "装饰", "翻新", "拆除", "清洁", "运维服务", "运营维护", "修缮"),
    ),
    (
        "老旧小区改造",
        ("老旧", "老旧小区", "棚改", "旧改", "既有建筑改造", "安置", "棚户区", "老旧改造", "老旧小区改造", "既有居住建筑", "城市更新", "片区改造", "老旧居住", "危旧房", "解危", "解困"),
        ("智能化", "智慧", "智慧化", "数字", "数字化", "信息化", "AI", "物联网", "智能"),
    ),
    (
        "零星维修",
        ("零星", "零星工程", "修缮", "小修", "应急抢修", "小品类", "维修", "整改", "零星维修", "日常维修", "抢修", "维护", "修补", "小修小补", "应急维修"),
        ("总承包", "EPC", "BT", "BOT", "PPP", "设计施工", "新建", "数据中心建设", "智能化系统集成", "新建工程", "主体施工"),
    ),
    (
        "房屋建筑",
        ("住宅", "办公楼", "厂房", "土建", "主体施工", "房屋建筑", "教学楼", "医院", "新建", "在建", "施工总承包", "房建", "公建", "商住楼", "安置房", "公租房", "人才公寓", "保障性住房"),
        ("纯装修", "纯维修", "仅装修", "仅维修", "装饰工程", "幕墙工程"),
    ),
    (
        "市政工程",
        ("道路", "桥梁", "隧道", "管网", "给排水", "燃气", "市政道路", "沥青", "市政", "人行道", "雨污分流", "污水管网", "供水管网", "电力管沟", "通信管道", "路灯", "标志标线", "交通设施"),
        ("住宅小区市政", "园区市政"),
    ),
    (
        "园林绿化",
        ("园林", "景观", "绿化", "花卉", "园林景观", "苗木", "草坪", "公园", "广场绿化", "行道树", "立体绿化", "屋顶绿化"),
        ("市政绿化养护", "道路绿化养护"),
    ),
    (
        "装饰装修",
        ("装饰", "装修", "幕墙", "精装", "二次装修", "装饰工程", "室内装修", "外立面", "幕墙工程", "精装修", "改造装修", "装饰装修"),
        ("纯维修", "仅维修", "零星维修", "应急维修"),
    ),
]

#: Classes of titles and their words (fixed values); the first class with a word in the title counts.
TITLE_CLASSES = {
    "result_notice": (
        "中标候选人公示表", "中标候选人公示", "成交结果公示", "成交结果公告", "谈判结果公示", "中选人确认公示表", "中选结果公示", "结果公示表", "结果公告", "结果公示", "成交结果确认公告", "中标结果公示", "成交候选人公示", "成交候选人公示表",
        "中选候选人公示", "中选人公示", "中选人公告", "拟中选候选人公示", "询价结果公示", "直接采购结果公示", "中选人确认公示", "成交候选人公告",
    ),
    "purchase_notice": (
        "采购公告", "询价公告", "采购邀请函", "竞争性谈判公告", "竞争谈判公告", "公开招标公告", "直接采购邀请", "招标公告", "询比公告", "谈判邀请", "邀请书", "单一来源",
    ),
    "change_notice": (
        "变更公告", "暂停招投标活动的公告", "变更公示", "变更补遗", "澄清补遗", "澄清说明", "更正公告", "澄清公告", "终止公告", "补遗", "补充通知", "澄清",
    ),
    "failed_notice": (
        "流标公示", "流标公示表", "流标公告",
    ),
    "rental_notice": (
        "招租公告", "招租结果公示", "拍卖公告",
    ),
}
